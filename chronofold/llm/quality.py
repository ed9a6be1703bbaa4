"""Quality by hierarchical empirical Bayes.

A classifier gives every document the evidence of its own text.  A host's
posterior is a beta-binomial mean of its documents' evidence and labels, shrunk
toward the global prior; a path's (a part of the host) is shrunk toward its
host's.  How strongly sites are shrunk is estimated from the spread between
sites, by grouped aggregation.  A document's score adds its own log-odds to
those of its path, without the document, relative to the prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .language_mixture import held_out
from .storage import frequent, salted_join, written
from .toxicity import fit_logistic

#: Labelled documents that the classifier is fitted on, at most.
FIT_ROWS = 20_000
FEATURES = ("loglen", "upper", "symbol", "digit", "space", "repeat", "shared", "wordlen", "lines", "wide")


def _features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text: shares of byte classes, repeated words and lines, word length."""
    out = []
    for at in range(0, len(column), 1000):
        data, offsets = bw.buffers(column.slice(at, 1000))
        n = np.diff(offsets)

        def share(mask, data=data, offsets=offsets, n=n):
            total = np.r_[0, np.cumsum(mask[data], dtype=np.int64)]
            return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)

        byte = np.arange(256)
        upper = (byte >= 65) & (byte <= 90)
        digit = (byte >= 48) & (byte <= 57)
        symbol = (byte > 32) & (byte < 127) & bw.nonletter_table() & ~np.isin(byte, list(b".,;:'\"!?-()"))
        mark = np.isin(byte, list(b"!?"))
        words, first = bw.word_hashes(data, offsets, bw.space_table(), bw.lower_table())
        lines, start = bw.word_hashes(data, offsets, byte == 10, np.arange(256, dtype=np.uint8))
        m, k = np.diff(first), np.diff(start)
        row = np.repeat(np.arange(len(n)), m)

        def repeated(values, row, count):
            """Share of values that occurred before in their row."""
            order = np.lexsort((values, row))
            v, r = values[order], row[order]
            again = np.r_[False, (v[1:] == v[:-1]) & (r[1:] == r[:-1])] if len(v) else np.zeros(0, bool)
            return np.bincount(r[again], minlength=len(count)) / np.maximum(count, 1)

        pairs = bw.mix64(words[:-1] * np.uint64(31) + words[1:]) if len(words) > 1 else words[:0]
        same = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
        out.append(
            np.stack(
                [np.log1p(m), share(upper), share(symbol), share(digit), share(bw.space_table()), repeated(pairs[same], row[:-1][same] if len(row) > 1 else row[:0], m),
                 share(mark), np.log1p(n / np.maximum(m, 1)), repeated(lines, np.repeat(np.arange(len(n)), k), k), share(byte >= 128)], 1
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def with_features(rows: DataFrame, body: str) -> DataFrame:
    """rows with the string column body replaced by _features array<double>; all other columns pass through."""
    schema = rows.schema
    at = schema.fieldNames().index(body)
    rest = [f for f in schema.fields if f.name != body]

    def run(batches):
        for b in batches:
            x = _features(b.column(at))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), flat], names=[*(f.name for f in rest), "_features"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", _features array<double>")


def classifier_logit(features: DataFrame) -> F.Column:
    """Log-odds of good quality from the column _features, fitted on a bounded sample of the rows with a label in good."""
    known = features.where("good is not null")
    # a threshold on the hash first, so that no partition sends more than its share to the driver
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    share = min(1.0, 1.1 * FIT_ROWS / max(1, known.count()))
    sample = known.where(place < int(share * (1 << 30))).orderBy(place, "_features").limit(FIT_ROWS)
    table = sample.select("_features", "good").toArrow()
    y = table.column("good").to_numpy().astype(float)
    if len(set(y)) < 2:
        return F.lit(0.0)
    x = table.column("_features").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    x = np.concatenate([np.ones((len(x), 1)), x, np.sqrt(x[:, 1:7])], 1)
    w, mean, scale = fit_logistic(x, y)
    w = w / scale
    w[0] -= float((w * mean)[1:].sum())
    f = [F.col("_features")[i] for i in range(len(FEATURES))]
    terms = [F.lit(1.0), *f, *[F.sqrt(v) for v in f[1:7]]]
    z = sum((F.lit(float(a)) * t for a, t in zip(w, terms, strict=True)), F.lit(0.0))
    return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))


def strength(groups: DataFrame, total: str, good: str, prior: F.Column) -> float:
    """Pseudo-documents of the prior by the method of moments: much where sites differ no more than chance makes them."""
    g = groups.where(F.col(total) > 0).select(F.col(total).alias("n"), (F.col(good) / F.col(total)).alias("r"), prior.alias("m"))
    s = g.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.pow(F.col("r") - F.col("m"), 2)).alias("ss"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("vv"), F.count("*").alias("k")).first()
    if not s["n"] or s["k"] < 2:
        return 1e6
    chance = s["vv"] / s["n"]
    between = (s["ss"] - s["k"] * chance) / max(s["n"] - s["nn"] / s["n"], 1e-9)
    return float(np.clip(chance / max(between, 1e-9) - 1, 1.0, 1e6))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: F.Column | None = None, path: F.Column | None = None, label_col: str = "quality", carry: tuple[str, ...] = ()) -> DataFrame:
    """Probability of good quality (label 1) for every row of docs.

    host and path are expressions over docs; by default the source, and the
    source's part in the row's language.  Null hosts and paths are sites of
    their own.  A document's evidence for its site is its label where it may
    teach, else the classifier's probability; its own site's posteriors leave
    its own evidence out, so that it counts once.  Returns one row per input
    row: doc_id, held_out, host, path, doc_score (the text's own probability),
    evidence, host_posterior, path_posterior, score, predicted, then the columns
    of docs named in carry, whose names must differ from these.  Labels are 0 or
    1; others, nulls and labels of held-out rows teach nothing; an id with
    different labels counts as good.  Without both labels the text has no
    evidence.  Null texts are empty.  Repeated rows and null ids are kept; an
    empty table gives an empty result.
    """
    host = F.col("source").cast("string") if host is None else host
    path = F.concat_ws("/", F.col("source").cast("string"), F.col("lang").cast("string")) if path is None else path
    site = F.md5(F.to_json(F.struct(F.col("_host").alias("h"), F.col("_path").alias("p")), {"ignoreNullFields": "false"}))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), host.alias("_host"), path.alias("_path"), F.col(f"`{text_col}`").cast("string").alias("_body"), *[F.col(f"`{c}`").alias(f"_carry{i}") for i, c in enumerate(carry)])
    marks = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("good")).where("good in (0, 1) and _id is not null").groupBy("_id").agg(F.max("good").alias("good")).where(~held_out("_id"))
    features = written(with_features(rows, "_body").join(marks.hint("merge"), "_id", "left").withColumns({"_site": site, "_n": F.monotonically_increasing_id()}), "quality")
    logit = classifier_logit(features)
    p = 1 / (1 + F.exp(-logit))
    scored = written(features.select(*[c for c in features.columns if c not in ("_features", "good")], logit.alias("_logit"), F.coalesce(F.col("good").cast("double"), p).alias("_e")), "scored")
    paths = written(scored.groupBy("_host", "_path", "_site").agg(F.count("*").alias("n"), F.sum("_e").alias("k")), "sites")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    total = hosts.agg(F.sum("hn"), F.sum("hk")).first()
    prior = float(min(max(total[1] / total[0], 1e-3), 1 - 1e-3)) if total[0] else 0.5
    a = strength(hosts, "hn", "hk", F.lit(prior))
    sites = written(paths.join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h"))).select("_site", "n", "k", "hn", "hk"), "sites")
    b = strength(sites, "n", "k", (F.col("hk") + a * prior) / (F.col("hn") + a))
    # hot sites are dealt over several tasks by row, so that equal texts are dealt too
    both = salted_join(scored, sites, "_site", frequent(scored.select("_site"), "_site"), F.col("_n"))
    both = both.withColumn("host_posterior", (F.col("hk") - F.col("_e") + a * prior) / (F.col("hn") - 1 + a))
    both = both.withColumn("path_posterior", (F.col("k") - F.col("_e") + b * F.col("host_posterior")) / (F.col("n") - 1 + b))
    inside = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_posterior")))
    score = 1 / (1 + F.exp(-(F.col("_logit") + F.log(inside / (1 - inside)) - F.lit(float(np.log(prior / (1 - prior)))))))
    return both.select(F.col("_id").alias("doc_id"), held_out("_id").alias("held_out"), F.col("_host").alias("host"), F.col("_path").alias("path"), (1 / (1 + F.exp(-F.col("_logit")))).alias("doc_score"), F.col("_e").alias("evidence"), "host_posterior", "path_posterior", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)])
