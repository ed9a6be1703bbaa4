"""Context documents against a plain loop that cuts one item at a time."""

import json
import random

from pyspark.sql import functions as F

from chronofold.operators import reports

LISTS = ("pending_attributes", "active_actions", "candidate_entities")


def plain(lists, scene, compact, changes, budget):
    doc = {**{k: list(v) for k, v in lists.items()}, "scene": scene, "recent_scene_changes": changes, "truncated": False}
    text = lambda: json.dumps(doc, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    compacted = False
    for name in reversed(LISTS):
        while len(text()) > budget and doc[name]:
            doc[name].pop()
            doc["truncated"] = True
    if len(text()) > budget:
        doc["scene"], doc["truncated"], compacted = compact, True, True
    return text(), doc["truncated"], compacted


def test_documents_are_cut_like_a_loop(spark):
    rng = random.Random(5)
    dumps = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    runs = [{n: [{"i": i, "t": "é\n\"" * rng.randrange(6)} for i in range(rng.choice((0, 0, 1, 4, 9)))] for n in LISTS} for _ in range(12)] + [{n: [] for n in LISTS}]
    scene, compact, changes = {"a": 1, "b": "x" * 30}, {"a": 1}, [{"w": 3}]
    whole = [len(plain(r, scene, compact, changes, 10**6)[0]) for r in runs]
    budgets = [sorted({1, 100, 128, 129, 145, 146, 147, n - 60, n - 1, n, n + 1, *[rng.randrange(100, n + 50) for _ in range(8)]}) for n in whole]
    scenes = spark.createDataFrame([(g, dumps(scene), dumps(compact), dumps(changes), b) for g, bs in enumerate(budgets) for b in bs], "g int, scene string, compact string, changes string, budget long")
    lists = {n: spark.createDataFrame([(g, i + 1, dumps(x)) for g, r in enumerate(runs) for i, x in enumerate(r[n])], "g int, rank long, item string") for n in LISTS}
    got = {(r.g, r.budget): (r.json, r.truncated, r.compacted) for r in reports.context_documents(scenes, lists, ["g"]).collect()}
    want = {(g, b): plain(runs[g], scene, compact, changes, b) for g, bs in enumerate(budgets) for b in bs}
    assert got == want and {x[1:] for x in want.values()} == {(False, False), (True, False), (True, True)}


def test_json_keys_are_sorted_and_nulls_stay(spark):
    row = spark.createDataFrame([(1, None, "ü")], "a int, b string, c string").select(F.explode(F.array(F.lit(1))), reports.sorted_json(z=F.col("a"), b=F.col("b"), m=F.col("c")).alias("j")).first()
    assert row.j == '{"b":null,"m":"ü","z":1}'
