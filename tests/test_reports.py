"""The window report on windows with nulls, absent parts, repeats and errors."""

from chronofold.operators import reports

_ANALYSIS = (
    "struct<window_summary:string,entities:array<struct<entity_id:string,name:string>>,actions:array<struct<actor_id:string,action:string,object_id:string,status:string>>,"
    "state_changes:array<struct<entity_id:string,attribute:string,before:string,after:string>>,observed_results:array<struct<object_id:string,result_type:string,result:string>>,uncertainties:array<struct<target:string,reason:string>>>"
)
_SCHEMA = f"run int, w int, status string, error struct<type:string,message:string>, analysis {_ANALYSIS}"


def test_parts(spark):
    step = ("a", "open", None, "ongoing")
    rows = [
        (1, 0, "ok", None, ("cable cut", [("e", "x"), (None, None)], [step, step], [("e", "door", "closed", "open")], None, [("person", "no"), ("device 1", None), ("device 2", "late")])),
        (1, 1, "ok", None, (None, [("e", "x")], [step], None, [("d", "sound", "beep")], [])),
        (1, 2, "error", ("Timeout", None), None),
        (1, 3, "ok", None, None),
        (2, 0, "error", None, ("not shown", [("e", "x")], None, None, None, None)),
    ]
    got = {tuple(r) for r in reports.window_report(spark.createDataFrame(rows, _SCHEMA), "device", "cable").collect()}
    assert got == {
        (1, "status", None, "ok", 3), (1, "status", None, "error", 1), (2, "status", None, "error", 1),
        (1, "summary", 0, "cable cut", 1), (1, "summary", 1, "", 1), (1, "summary", 2, "ERROR: Timeout - ", 1), (1, "summary", 3, "", 1), (2, "summary", 0, "ERROR:  - ", 1),
        (1, "timeline", 0, "cable cut", 1), (1, "entity", None, "e (x)", 2), (1, "entity", None, "unknown (unknown)", 1),
        (1, "action", None, "a open  [ongoing]", 3), (1, "action_window", 0, "a open  [ongoing]", 2), (1, "action_window", 1, "a open  [ongoing]", 1),
        (1, "change", 0, "e door closed -> open", 1), (1, "result", 1, "d sound - beep", 1), (1, "uncertainty", 0, "device 1 | ", 1),
    }
    assert reports.window_report(spark.createDataFrame([], _SCHEMA), "device", "cable").count() == 0


def test_a_cut_takes_an_item(spark):
    """A list one character beyond its budget loses its last item, though the mark of the cut would free that character."""
    items = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb")], "g int, o int, item string")
    size = lambda n: [(r.o, r.truncated) for r in reports.within_budget(items, ["g"], ["o"], reports.F.length("item"), n, freed=1).collect()]
    assert size(10) == [(1, False), (2, False)] and size(9) == [(1, True)]
