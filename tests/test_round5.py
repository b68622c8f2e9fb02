"""What was found in round 4: work that is laid out anew gives the same rows."""

import random

import pandas as pd
import pytest

from tallyloom.operators import recommend, resolve


def bought(spark, sets):
    return spark.createDataFrame([(k, p, 1.0) for k in sets for p in sorted(sets[k])], "kunde_id long, produkt_id string, umsatz double")


def test_evidence_deals_sets_and_no_pairs_of_them(spark):
    """Tiles and parts of sets, over a catalogue of more than a word of bits, give what comparing all customers gives; no product of blocks stands in the plan."""
    draw = random.Random(4)
    sets = {k: frozenset(f"p{draw.randint(0, 79):02}" for _ in range(draw.randint(1, 40))) for k in range(150)} | {k: frozenset({"p01", "p02", "p79"}) for k in range(150, 156)}
    wanted = [(k, p) for k in range(0, 156, 3) for p in ("p01", "p40", "p79", "none")]
    want = set()
    for k, p in wanted:
        alike = lambda j: (-round(len(sets[k] & sets[j]) / len(sets[k] | sets[j]), 4), -len(sets[k] & sets[j]), j)  # noqa: B023, E731
        near = sorted((j for j in sets if j != k and p in sets[j] and sets[k] & sets[j]), key=alike)[:3]
        want |= {(k, p, j, tuple(sorted(sets[k] & sets[j])), len(sets[k] & sets[j]), -alike(j)[0], n + 1) for n, j in enumerate(near)}
    frame = spark.createDataFrame(wanted, "kunde_id long, produkt_id string")
    with pytest.MonkeyPatch.context() as m:
        for name, value in (("ROWS_OF_BLOCK", 20), ("TILE_BYTES", 1200), ("ASKING", 30)):
            m.setattr(recommend, name, value, raising=False)
        found = recommend.evidence(bought(spark, sets), frame)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {(r.kunde_id, r.produkt_id, r.anderer, tuple(r.gemeinsam), r.n_gemeinsam, r.jaccard, r.nr) for r in found.collect()} == want
    assert "CartesianProduct" not in plan


def test_explanations_read_purchases_once(spark):
    """What is explained comes from one table of customers' lists; purchases are not evaluated for each use."""
    draw = random.Random(5)
    sets = {k: {f"p{draw.randint(0, 9)}" for _ in range(4)} for k in range(20)}
    read = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            read.add(len(b))
            yield pd.DataFrame(b)

    rows = bought(spark, sets)
    wanted = spark.createDataFrame([(k, "p1") for k in sets if "p1" not in sets[k]], "kunde_id long, produkt_id string")
    got = recommend.explain(rows.mapInPandas(tell, rows.schema), wanted).collect()
    assert len(got) == wanted.count() and all(r.belege for r in got if any(sets[r.kunde_id] & s for s in sets.values() if "p1" in s))
    assert read.value == sum(map(len, sets.values()))


def test_candidates_of_small_blocks_are_dealt_once(spark):
    """Only blocks of more rows than a part holds are copied to several parts; parts give the pairs of the whole block."""
    draw = random.Random(11)
    rows = [(i, draw.choice(["", "10", "11", "12"]), draw.choice("abc")) for i in range(120)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] == b[1] != "" or a[2] == b[2])}
    frame = spark.createDataFrame(rows, "firma_id long, area string, letter string")
    for most in (resolve.ROWS_OF_PART, 7):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(resolve, "ROWS_OF_PART", most)
            found = resolve.candidates(frame)
            got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want
    assert "explode([0,1,2" not in found._jdf.queryExecution().executedPlan().toString()
