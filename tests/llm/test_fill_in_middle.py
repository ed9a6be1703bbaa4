"""Fill-in-the-middle against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from chronofold.llm import fill_in_middle as fim


def plain(doc, text, unit="char", rate=90):
    text = text or ""
    g = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(g[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = list(text) if unit == "char" else re.findall(r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc, n, form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "a", "é", "語🤦🏼‍♂️é", "<P>", "x<S", "S>x", "a<M>b", "<", "<<P", "P>", " \t\n", "one two  three\nfour", "z" * 200_000 + "é", "語" * 3_000_000, "\x00b<\x00"]
    return [(i, t) for i, t in enumerate(texts * 12)] + [(None, "no id"), (3, "same"), (3, "same"), (4, "<P"), (5, "<S>" * 9)]


@pytest.mark.parametrize("unit", ["char", "word"])
def test_same_as_plain(spark, rows, unit):
    some = [r for r in rows if len(r[1] or "") < 1_000_000 or r[0] < 30]
    df = spark.createDataFrame([(*r, "clash", 1) for r in some], "doc_id long, text string, output string, _h0 int")
    found = fim.fill_in_middle(df, unit=unit).withColumn("back", fim.restored())
    key = lambda r: str([x if not isinstance(x, str) else hashlib.md5(x.encode()).hexdigest() for x in r])
    got = found.collect()
    assert sorted(key(r[:6]) for r in got) == sorted(key(plain(*r, unit=unit)) for r in some)
    assert sorted(key((r.doc_id, r.back)) for r in got) == sorted(key((d, t or "")) for d, t in some)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_partitions_rate_and_empty_table(spark, rows):
    df = spark.createDataFrame([r for r in rows if len(r[1] or "") < 1000], "doc_id long, text string")
    key = F.struct("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    one, many = (sorted(map(str, fim.fill_in_middle(d).select(key).collect())) for d in (df.coalesce(1), df.repartition(7)))
    assert one == many
    assert {r.form for r in fim.fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert fim.fill_in_middle(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        next(fim.transform(__import__("pyarrow").array(["x"]), __import__("numpy").zeros((4, 1), int), unit="line"))
