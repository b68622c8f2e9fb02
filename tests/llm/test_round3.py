"""Centroids, personal data and the filter audit against plain Python, with odd and hot inputs."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import centroids, filter_audit, personal, queries

SF = "/root/testdata/sf0.01"
CLASHES = "id vec state change deepest cluster distance looked key part mask task mark fp found kind n good toxic counts since".split()


# ---- centroids


def brute_clusters(vectors, k=8, rounds=10, size=64, seed=3):
    """Plain Lloyd rounds in Python's integers: cluster and squared distance by place, and the centroids."""
    rows = [(i, [math.floor(1024 * v) for v in x]) for i, x in vectors if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    now = [x for _, x in sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in rows]
        for j in range(len(now)):
            mine = [x for (_, x), o in zip(rows, own) if o == j]
            if mine:
                now[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted((str(i), nearest(x)[1], nearest(x)[0]) for i, x in rows), now


def found_clusters(frame, **kw):
    found, last = centroids.clusters(frame, **kw)
    rows = found.collect()
    return sorted((str(r.vec_id), r.cluster, r.distance) for r in rows), last, rows


def test_op11(spark):
    rows = [r.asDict() for r in queries.QUERIES["op11_centroids"](spark, SF).collect()]
    want, last = brute_clusters(duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall())
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in rows) == want
    sums = Counter()
    for _, c, d in want:
        sums[c] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last]
    assert all((r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) == (sums[r["cluster"]], sum(sums.values()), marks[r["cluster"]]) for r in rows)


def test_op11_bounds_save_distances(spark):
    """On vectors in groups most distances are never measured, and the result is that of measuring all."""
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 2, (12, 16))
    rows = [(i, [float(v) for v in middles[i % 12] + rng.normal(0, 0.4, 16)]) for i in range(900)]
    kw = {"k": 12, "size": 16, "rounds": 8}
    got, last, each = found_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), **kw)
    assert (got, last) == brute_clusters(rows, **kw)
    assert sum(r.n_distances for r in each) < 0.5 * len(rows) * 12 * 9


def test_op11_ties_and_odd_rows(spark):
    """Whole-number grids tie often; nulls, wrong lengths, NaN, repeated rows and null ids."""
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(300)] + [(None, [0.0, 1.0, 2.0, 0.5]), (None, None), (400, [1.0]), (401, [float("nan")] * 4), (402, [None, 1.0, 1.0, 1.0]), (403, [float("inf"), 0.0, 0.0, 0.0]), (7, [1.0, 1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in CLASHES}).repartition(3)
    for k in (1, 2, 3, 8, 40):
        kw = {"k": k, "size": 4, "rounds": 6}
        got, last, _ = found_clusters(frame, **kw)
        assert (got, last) == brute_clusters(rows, **kw), k
    few = frame.where("vec_id < 3")
    got, last, _ = found_clusters(few, size=4)
    assert (got, last) == brute_clusters(rows[:3], size=4) and len(last) == 3
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(50)], "vec_id long, embedding array<float>")
    out = centroids.described(*centroids.clusters(same)).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in out} == {(0, 0, 0)}
    assert centroids.described(*centroids.clusters(frame.limit(0))).count() == 0
    with pytest.raises(Exception, match="components must be below"):
        centroids.clusters(spark.createDataFrame([(1, [70000.0] * 64)], "vec_id long, embedding array<double>"))


def test_op11_bounds_hold_after_moves():
    """Each round's bounds enclose the exact distances, with fewer centroids carried as rounds go on."""
    rng = np.random.default_rng(1)
    x, now = rng.integers(-500, 500, (200, 8)), rng.integers(-500, 500, (9, 8))
    bounds = centroids.Bounds(now, np.zeros(9), 4)
    state = bounds.first(x)
    for b in (4, 3, 3, 2, 2):
        after = now + rng.integers(-40, 40, now.shape)
        bounds = centroids.Bounds(after, np.sqrt(((after - now) ** 2).sum(axis=1).astype(float)) * centroids.UP, b)
        state, _ = bounds.moved(x, state)
        now = after
        far = np.sqrt(((x[:, None] - now) ** 2).sum(axis=2).astype(float))
        assert (state["order"][:, 0] == far.argmin(axis=1)).all()
        assert (state["upper"] >= far.min(axis=1)).all()
        for i, s in enumerate(state):
            carried = s["order"][1:]
            assert (s["lower"] <= far[i, carried]).all() and s["rest"] <= min(far[i, j] for j in range(9) if j not in s["order"])


# ---- personal data


def brute_base(text):
    """The contract's expressions as they stand."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(reversed(d))) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def test_op12(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    found = {r.doc_id: r for r in queries.QUERIES["op12_personal_data"](spark, SF).collect()}
    assert set(found) == set(texts)
    total = Counter()
    for i, t in texts.items():
        base, r = brute_base(t or ""), found[i]
        total.update(k for _, k, _ in base)
        said = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert set(said.split(",")) <= set(r.spans.split(",")) and r.scores.count(",") == r.spans.count(",")
    assert all(total[k] for k in range(4))


def test_op12_base_on_random_strings():
    """Expressions that are anchored for speed find what the plain ones find."""
    rng = random.Random(11)
    for _ in range(6000):
        pool = rng.choice(["a@.-1", "1.2.", "0123456789 -", "+1 ().-9x", "aB9@.%+-_ é", "12@a.b "])
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        assert sorted(personal.base(text)) == brute_base(text), text
    card = "4539 1488 0343 6467"
    assert sorted(personal.base(f"x{card}-")) == brute_base(f"x{card}-") == [(1, 2, 20)]


def test_op12_checksums_and_context():
    kinds = lambda text: [personal.KINDS[k] for _, k, _, _ in personal.spans(text)]
    assert personal.luhn("4539148803436467") and not personal.luhn("4539148803436468")
    assert personal.mod_97("DE89370400440532013000") and not personal.mod_97("DE88370400440532013000")
    assert "iban" in kinds("Konto DE89 3704 0044 0532 0130 00 AND MORE") and "iban" in kinds("GB82WEST12345698765432")
    assert "iban" not in kinds("Konto DE88 3704 0044 0532 0130 00") and "iban" not in kinds("XX89370400440532013000")
    assert kinds("ssn 123-45-6789") == ["insurance"] and kinds("item 123-45-6789") == [] and kinds("ssn 666-45-6789") == []
    assert kinds("Telefon 030 1234567") == ["local"] and kinds("Artikel 030 1234567") == []
    text = "call me: +49 30 1234567 or write to a.b@example.org"
    assert [(k, round(s, 2)) for _, k, _, s in personal.spans(text)] == [(3, 1.0), (0, 1.0)]
    (_, _, _, low), (_, _, _, plain) = *personal.spans("version 1.2.3.4"), *personal.spans("wow 1.2.3.4")
    assert (round(low, 2), plain) == (0.3, 0.6)


def test_op12_odd_rows(spark):
    long = "1" * 300_000 + " " + "a" * 300_000 + "@ " + "1." * 100_000 + " " + "x@" * 50_000 + " +" + "1 (" * 50_000 + " " + "a1" * 100_000 + " me@x.org"
    rows = [(1, None), (2, ""), (3, long), (None, "mail me@x.org 😀 you@y.org"), (4, "a@b.c"), (4, "a@b.c"), (5, "\x00 1.2.3.4")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHES})
    out = personal.personal_data(frame).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip) for r in out) == [("1", 0, 0), ("2", 0, 0), ("3", 1, 25_000), ("4", 1, 0), ("4", 1, 0), ("5", 0, 1), ("None", 2, 0)]
    (smile,) = [r.found for r in out if r.doc_id is None]
    assert [(f["start"], f["stop"]) for f in smile] == [(5, 13), (16, 25)]
    hidden = personal.masked(frame)
    assert hidden.columns == frame.columns
    assert sorted((str(r.doc_id), r.text) for r in hidden.collect() if r.doc_id in (1, 4, 5, None)) == [("1", None), ("4", "[EMAIL]"), ("4", "[EMAIL]"), ("5", "\x00 [IP]"), ("None", "mail [EMAIL] 😀 [EMAIL]")]
    assert personal.personal_data(frame.limit(0)).count() == 0 and personal.masked(frame.limit(0)).count() == 0


# ---- filter audit


def brute_audit(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic). Every order applied to every document."""
    order_id = lambda i: (i is None, i or 0)
    first = {}
    for i, t, _ in docs:
        first[t or ""] = min(first.get(t or "", (True, 0)), order_id(i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": order_id(i) > first[t]}
        rows.append((part or "", fails, i in good, i in toxic))
    out, by_filter = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone, kept = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                out[part, order, step] = [len(kept), len(gone), sum(r[0][f] for r in mine) - len(gone), sum(r[0][f] and sum(r[0].values()) == 1 for r in mine), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                by_filter[part, f] += len(gone)
                left = kept
    return {(p, o, s): (*v, by_filter[p, o[s - 1]]) for (p, o, s), v in out.items()}


def found_audit(docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_op13(spark):
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in queries.QUERIES["op13_filter_audit"](spark, SF).collect()}
    docs = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()
    assert found == brute_audit(docs, duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall())


def test_op13_copies_across_tasks(spark):
    """One text held by most rows spans many ranges; ids repeat, are null, and meet labels that repeat or are null."""
    rng = random.Random(2)
    pool = ["copy " * 120, "", None, "A b C", "x $ y", " ".join(f"w{i}" for i in range(150)), "é" * 40 + "ABCDE"]
    docs = [(rng.choice([None, *range(400)]), pool[0] if rng.random() < 0.6 else rng.choice(pool), rng.choice(["en", "de", None, ""])) for _ in range(700)]
    labels = [(rng.choice([None, *range(400)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in CLASHES}).repartition(5)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(docs, labels)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 8, 37):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert found_audit(frame, told) == want, n
        tasks = filter_audit.judged(frame, "doc_id", "text", "lang").where("mark IS NOT NULL AND mask IS NOT NULL").select("task").distinct().count()
        assert tasks > 10  # the copies do reach many tasks
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_op13_equal_fingerprints(spark, monkeypatch):
    """Texts of one fingerprint are told apart by the whole text, over task boundaries too."""
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: F.lit(1).cast("long") + F.lit(0) * F.length(c[0]))
    docs = [(i, f"text {i % 3}", "en") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = filter_audit.counters(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert sum(r.n for r in rows if r["mask"] & filter_audit.COPY) == 57


def test_op13_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    told = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, told).count() == 0
    docs = [(1, None, None), (2, "word " * 300_000, "en"), (3, "word " * 300_000, "en")]
    assert found_audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), told) == brute_audit(docs, [])


def test_op13_copies_of_labels_are_never_broadcast(spark, tmp_path):
    """Spark's estimate of the labels' size is that of their file, not of the copies that a salted join makes of them."""
    spark.range(2000).selectExpr("id AS doc_id", "1 AS quality", "1 AS toxic").write.parquet(f"{tmp_path}/labels")
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'de' AS lang")
    found = filter_audit.counters(docs, spark.read.parquet(f"{tmp_path}/labels"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_salt" in line], plan
    assert sum(r.n for r in found.collect()) == sum(r.good for r in found.collect()) == 50
