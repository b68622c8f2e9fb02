"""Findings of the third round: similarity join of companies, ranks of one and of all customers."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from tallyloom.functions import strings
from tallyloom.operators import graph, recommend, resolve
from tests.test_engines import COMPANY, brute_duplicates, made_up_companies, plain_edit


@pytest.mark.parametrize("lengths", [(0, 1, 3, 8, 12, 16), (0, 2, 7, 30, 32), (0, 1, 9, 63, 64), (5, 12, 64, 70, 230)])
@pytest.mark.parametrize("cells", [strings.CELLS, 100])
def test_likeness_of_many_pairs_as_of_each(monkeypatch, lengths, cells):
    monkeypatch.setattr(strings, "CELLS", cells)
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdü€ 𝄞") for _ in range(draw.choice(lengths))) for _ in range(100)]
    i, j = (np.array([draw.randrange(100) for _ in range(800)]) for _ in "ij")
    x = strings.Coded(words)
    assert strings.match_ratios(x, i, j).tolist() == [SequenceMatcher(None, words[a], words[b]).ratio() for a, b in zip(i, j)]
    got = strings.edit_ratios(x, i, j)
    want = [plain_edit(words[a], words[b]) if max(len(words[a]), len(words[b])) <= strings.LONGEST else np.nan for a, b in zip(i, j)]
    assert np.array_equal(got, np.array(want), equal_nan=True)
    bag, left = strings.bags(words)
    short = np.maximum(x.size[i], x.size[j]) <= strings.LONGEST
    assert (strings.subsequences(x, i[short], j[short]) <= ((bag[i] * bag[j]).sum(axis=1) + np.minimum(left[i], left[j]))[short]).all()


@pytest.mark.parametrize(("similar", "plain"), [(resolve.ratio, lambda a, b: SequenceMatcher(None, a, b).ratio()), (resolve.edit_ratio, plain_edit)])
def test_duplicates_meet_once_and_are_compared_where_they_meet(spark, monkeypatch, similar, plain):
    """No pair is sorted out or joined to its rows again; blocks in parts, many towns, long names and towns."""
    monkeypatch.setattr(resolve, "ROWS_OF_KEY", 40)
    draw = random.Random(5)
    rows = made_up_companies(160, 3)
    rows += [(1000 + i, f"{name} {'lang ' * draw.randrange(12, 45)}", plz, f"{town or ''}{'stadt' * draw.choice([0, 15])}", kind) for i, (_, name, plz, town, kind) in enumerate(rows[:40])]
    rows += [(2000 + i, name, plz, f"{town} am {draw.randrange(10**6)}", kind) for i, (_, name, plz, town, kind) in enumerate(rows[:100])]
    frame = spark.createDataFrame(rows, COMPANY)
    found = resolve.duplicates(frame, similar)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan  # the sizes of blocks
    got = found.collect()
    want = brute_duplicates(sorted(resolve.prepared(frame).collect(), key=lambda r: r.firma_id), plain)
    assert len(got) == len(want) > 60 and {(r.a_id, r.b_id) for r in got} == set(want)
    assert all(abs(r.score - want[r.a_id, r.b_id]) < 2e-4 for r in got)
    assert any(max(r.a_id, r.b_id) in range(1000, 2000) for r in got)


def revenue(spark, customers=60, products=40, empty=()):
    draw = random.Random(9)
    rows = [(k, f"p{draw.randrange(products)}", float(draw.randrange(1, 9))) for k in range(customers) for _ in range(4)]
    rows += [(3, "p1", -2.0), (5, "p2", 0.0), (900, "p3", 0.0), *empty]
    return spark.createDataFrame(rows, "kunde_id int, produkt_id string, umsatz double")


def test_ranks_of_one_customer_without_edges_written(spark, monkeypatch):
    """The steps are taken among products; only what has no customer or product, and large catalogues, go by joins of edges."""
    start = spark.createDataFrame([("k:3",)], "start string")
    of = lambda frame: {(r.start, r.node): r.score for r in frame.collect()}
    plain, odd = revenue(spark), revenue(spark, empty=[(None, "p1", 1.0)])
    exact = [of(graph.personalised_pagerank(graph.purchase_edges(rows), start, tolerance=1e-2)) for rows in (plain, odd)]
    assert of(recommend.ranks_of_one(odd, start, 1e-2)) == pytest.approx(exact[1], abs=1e-12)
    monkeypatch.setattr(graph, "purchase_edges", None)
    assert of(recommend.ranks_of_one(plain, start, 1e-2)) == pytest.approx(exact[0], abs=1e-12)
    with pytest.raises(TypeError):
        recommend.ranks_of_one(odd, start, 1e-2)


def test_hybrid_of_a_small_catalogue_joins_no_ranks(spark, monkeypatch):
    rows = revenue(spark, 30, 12)
    of = lambda frame: {(r.kunde_id, r.produkt_id): (r.ppr, r.svd, r.hybrid, r.match) for r in frame.collect()}
    monkeypatch.setattr(recommend, "BITS", 0)
    joined = of(recommend.hybrid(rows, iterations=6))
    monkeypatch.setattr(recommend, "BITS", 1024)
    monkeypatch.setattr(recommend, "customer_ranks", None)
    monkeypatch.setattr(recommend, "gram_times", None)
    got, settled = of(recommend.hybrid(rows, iterations=6)), of(recommend.hybrid(rows))
    assert set(got) == set(joined) == set(settled)
    assert all(got[k] == pytest.approx(joined[k], abs=1e-6) for k in joined)
    late = of(recommend.hybrid(rows, iterations=400))
    assert all(settled[k] == pytest.approx(late[k], abs=1e-6) for k in late)
