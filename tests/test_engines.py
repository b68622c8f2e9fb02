"""Rules worked out by hand: boundaries, missing values, empty frames, planted structure."""

import itertools
import math
import random
from datetime import date, datetime
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import exprs
from tallyloom.operators import actions, anomaly, autoencoder, basket, churn, configure, deals, ensemble, graph, margin, metric, monitor, quantile, recommend, resolve, series
from tallyloom.plans import catalog


def one(df):
    return df.collect()[0]


def test_expressions(spark):
    rows = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "v string")
    assert [r[0] for r in rows.select(exprs.number("v")).collect()] == [1.5, 0.0, 0.0, 0.0]
    words = spark.createDataFrame([(" nan ",), ("—",), (None,), (" Hahn ",)], "v string")
    assert [r[0] for r in words.select(exprs.cleaned("v")).collect()] == ["", "", "", "Hahn"]
    numbers = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "v double")
    assert [r[0] for r in numbers.select(exprs.even(F.col("v"))).collect()] == [0.0, 2.0, 2.0, -0.0]
    assert one(spark.range(1).select(exprs.even(F.lit(1234.0), -1), exprs.growth(F.lit(5.0), F.lit(0.0)))) == (1230.0, 0.0)
    names = spark.createDataFrame([("Müller-Wagner GmbH & Co. KG",), ("  ACME   AG ",)], "v string")
    assert [r[0] for r in names.select(exprs.company_name(F.col("v"))).collect()] == ["mueller wner", "acme"]
    units = spark.createDataFrame([("beer_liters",), ("stromverbrauch_kwh",), ("umsatz_eur",), ("food_orders",), ("staff",)], "v string")
    assert [r[0] for r in units.select(exprs.unit_of(F.col("v"))).collect()] == ["Liter", "Kilowattstunden", "Euro", "Bestellungen", "Einheiten"]


def offers(spark, rows):
    return spark.createDataFrame(rows, "angebot_id string, vertriebsmitarbeiter string, umsatz double, rabatt_pct double, deckungsbeitrag_pct double")


def test_margin(spark):
    df = offers(spark, [("a", "Meyer", 1000.0, 20.0, 10.0), ("b", "Meyer", 500.0, 10.0, 15.0), ("c", "Huber", 200.0, 5.0, 30.0), ("d", "Huber", None, 5.0, 5.0)])
    k = one(margin.kpis(df))
    assert (k.leaks, k.potenzial, k.leak_volumen, k.ausreisser, k.total) == (2, 50.0, 1000.0, 1, 4)
    top = margin.top_leaks(df).collect()
    assert [r.angebot_id for r in top] == ["d", "a"] and top[1].preis_plus_pct == 4.5
    s = one(margin.spread(margin.summary(df, "vertriebsmitarbeiter"), "vertriebsmitarbeiter"))
    assert (s.schlechtester, s.bester) == ("Meyer", "Huber") and s.potenzial == pytest.approx(1500 * (17.5 - 12.5) / 100)
    assert one(margin.kpis(df.limit(0))).total == 0


def test_margin_derives_what_is_missing(spark):
    df = spark.createDataFrame([(100.0, 80.0, 2.0), (100.0, 0.0, 1.0), (0.0, 5.0, 1.0)], "listenpreis double, verkaufspreis double, menge double")
    got = margin.derive(df).collect()
    assert [r.deckungsbeitrag_pct for r in got] == [31.2, None, 100.0]
    assert [r.rabatt_pct for r in got] == [20.0, 100.0, None] and [r.umsatz for r in got] == [160.0, 0.0, 5.0]


def buys(spark, *pairs):
    return spark.createDataFrame([(k, p, 1.0) for k, p in pairs], "kunde_id string, produkt_id string, umsatz double")


def test_basket(spark):
    own = basket.owned(buys(spark, ("1", "A"), ("1", "B"), ("2", "A"), ("2", "B"), ("3", "A"), ("4", "C")))
    pair = basket.pairs(own).collect()
    assert [tuple(r) for r in pair] == [("A", "B", 2, 50.0, 66.7, 1.33)]
    rec = basket.recommend(own, basket.pairs(own)).collect()
    assert [(r.kunde_id, r.produkt_id, r.score, r.rang) for r in rec] == [("3", "B", 2.66, 1)]
    why = basket.evidence(own, basket.recommend(own, basket.pairs(own))).collect()
    assert sorted((r.anderer, r.gemeinsam) for r in why) == [("1", 1), ("2", 1)]


def account(spark, **values):
    base = dict(kunde_id="k", umsatz_ytd=100.0, umsatz_vorjahr=100.0, wettbewerber_produktgruppe="nan", wettbewerber_aktiv=0)
    names = "bestellungen_ytd bestellungen_vorjahr tage_seit_letztem_einkauf produkte_aktuell produkte_vorjahr service_faelle service_faelle_vorjahr reklamationen reklamationen_vorjahr ansprechpartner_wechsel zahlungsverzug_tage mahnungen angebote_ytd angebote_vorjahr preisanpassung_pct kontakte_ytd kontakte_vorjahr"
    row = {n: 0.0 for n in names.split()} | base | values
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in row.items()))


def test_churn(spark):
    calm = one(churn.scored(account(spark)))
    assert (calm.risiko, calm.segment, calm.dominant) == (0.0, "Stabil", "umsatz")
    bad = one(churn.scored(account(spark, umsatz_ytd=50.0, tage_seit_letztem_einkauf=100.0, wettbewerber_aktiv=1, wettbewerber_produktgruppe="Pumpen", produkte_vorjahr=3.0, ansprechpartner_wechsel=5.0, mahnungen=9.0, zahlungsverzug_tage=99.0)))
    assert (bad.risiko, bad.segment, bad.frist, bad.umsatz_risiko) == (66.0, "Kritisch", "innerhalb 48 h", 33.0)
    edge = one(churn.scored(account(spark, umsatz_ytd=70.0, tage_seit_letztem_einkauf=100.0, bestellungen_ytd=6.0, bestellungen_vorjahr=10.0)).select("risiko", "segment"))
    assert tuple(edge) == (42.0, "Gefährdet")
    assert churn.signals(churn.scored(account(spark, umsatz_ytd=92.5))).count() == 1
    assert one(churn.kpis(churn.scored(account(spark).limit(0)))).kunden == 0


def test_actions(spark):
    names = "kunde_id vertriebsmitarbeiter umsatz_ytd umsatz_vorjahr letzter_kontakt_tage wettbewerber_aktiv offene_opps opp_wert produktluecken_wert portfolio_abdeckung_pct service_tickets service_tickets_vorquartal kontakte_aktiv kontakte_gesamt trigger_event".split()
    rows = [("a", "R", 88.0, 100.0, 1, 0, 0, 0.0, 0.0, 100, 0, 0, 5, 5, "—"), ("b", "S", 200_000.0, 100_000.0, 1, 1, 0, 0.0, 5_000.0, 50, 9, 2, 1, 4, "Neubau"), ("c", "R", 1.0, 1.0, 1, 0, 0, 0.0, 0.0, 100, 0, 0, 5, 5, "none")]
    got = {r.kunde_id: r for r in actions.ranked(spark.createDataFrame(rows, names)).collect()}
    assert set(got) == {"a", "b"} and got["a"].dominant == "churn" and got["b"].score == 100.0
    assert {s.key for s in got["b"].signale} == {"wettbewerb", "trigger", "cross_sell", "service", "beziehung"}
    assert got["a"].roh == float(np.rint(30 * 3 * (12 / 15) * (math.log10(2) + 0.4) * 10) / 10)
    assert actions.ranked(spark.createDataFrame(rows, names), rep="R").count() == 1


def deal_frames(spark, **values):
    row = dict(opp_id=1, kunde_id="k", produkt_id="p", vertriebsmitarbeiter="v", branche="B", deal_wert=100_000.0, tage_in_stage=10, letzter_kontakt_tage=20, wettbewerber="—", rabatt_gefordert_pct=5, crm_probability=50, status="offen") | values
    deal = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in row.items()))
    contacts = spark.createDataFrame([(1, "Technik", 1, "positiv", 0), (1, "CFO / Einkaufsleitung", 0, "negativ", 1), (7, "Technik", 1, "positiv", 0)], "opp_id int, rolle string, involviert int, sentiment string, wettbewerber_kontakt int")
    return deal, contacts


def test_deals(spark):
    quiet = one(deals.scored(*deal_frames(spark)))
    assert (quiet.p_graph, quiet.ampel, quiet.top_risiko, quiet.erwartungswert) == (50.0, "gruen", None, 50_000.0)
    hard = one(deals.scored(*deal_frames(spark, deal_wert=250_000.0, wettbewerber="X", letzter_kontakt_tage=31, rabatt_gefordert_pct=18)))
    assert hard.p_graph == 50 - 14 - 7 - 6 - 10 - 8 and hard.ampel == "rot" and hard.top_risiko == "Finanzfreigabe nicht eingebunden"
    edges = deals.graph(*deal_frames(spark, wettbewerber="X"))
    assert {r.rel for r in edges.collect()} == {"GEHOERT_ZU", "BETRIFFT", "BETREUT", "KONKURRIERT_UM", "INVOLVIERT"}
    assert deals.ego(edges, "opp:1").count() == 5


def test_similar_deals_fall_back_to_all_branches(spark):
    kind = "opp_id int, branche string, deal_wert double, status string"
    history = spark.createDataFrame([(i, "B", float(i), "gewonnen") for i in range(10, 30)], kind)
    asked = spark.createDataFrame([(1, "B", 15.2, "offen"), (2, "neu", 28.9, "offen")], kind)
    got = deals.similar(asked, history, 3).collect()
    assert sorted((r.opp_id, r.nr, r.alt_wert) for r in got) == [(1, 1, 15.0), (1, 2, 16.0), (1, 3, 14.0), (2, 1, 29.0), (2, 2, 28.0), (2, 3, 27.0)]


def test_similar_deals_with_ties(spark):
    """Equal values and equal distances on both sides: the smallest ids, whatever stands before in the order."""
    kind = "opp_id int, branche string, deal_wert double, status string"
    draw = random.Random(4)
    history = [(i, draw.choice("AB") if i < 150 else None, float(draw.choice((10, 10, 10, 12, 14, 20))), "gewonnen") for i in range(160)] + [(900, "A", None, "verloren")]
    asked = [(1000 + i, draw.choice(("A", "B", "C", None)), float(draw.choice((8, 10, 11, 12, 13, 30))), "offen") for i in range(60)] + [(2000, "A", None, "offen")]
    got = {}
    for r in deals.similar(spark.createDataFrame(asked, kind), spark.createDataFrame(history, kind)).collect():
        got.setdefault(r.opp_id, []).append((r.nr, r.alt_id))
    known = {b for _, b, _, _ in history if b}
    for i, b, v, _ in asked[:-1]:
        pool = [(abs(w - v), str(j)) for j, c, w, _ in history if w is not None and (c == b if b in known else True)]
        assert sorted(got[i]) == [(n + 1, j) for n, (_, j) in enumerate(sorted(pool)[:5])]
    assert 2000 not in got and deals.similar(spark.createDataFrame(asked, kind).limit(0), spark.createDataFrame(history, kind)).count() == 0


def test_nearest_in_blocks_as_whole(spark):
    draw = np.random.default_rng(0)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    bank = vectors.where("vec_id % 3 = 0")
    whole = {r.vec_id: r.distance for r in anomaly.nearest(vectors, bank).collect()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(metric.blocks, "__defaults__", (7,))
        m.setattr(metric, "SIZE", 3)
        blocks = {r.vec_id: r.distance for r in anomaly.nearest(vectors, bank).collect()}
    assert len(whole) == 300 and whole == pytest.approx(blocks)


def test_bank_round_trip(spark, tmp_path):
    bank = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    anomaly.save_bank(bank, spark.createDataFrame([(0.5, 2.0)], "schwelle double, maximum double"), str(tmp_path))
    back, limit = anomaly.load_bank(spark, str(tmp_path))
    assert back.collect() == bank.collect() and tuple(limit.first()) == (0.5, 2.0)


def test_number_formats(spark):
    from tallyloom.functions import exprs

    rows = spark.createDataFrame([(1234567.5, "Brand#1 x"), (-0.3, " a  b"), (2.5, ""), (-1500.0, "z")], "x double, t string")
    got = rows.select(exprs.whole(F.col("x")), exprs.signed(F.col("x")), exprs.grouped(F.col("x")), exprs.euros(F.col("x")), exprs.first_word(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("1234568", "+1234568", "1,234,568", "1.234.568 €", "Brand#1"), ("-0", "-0", "-0", "-0 €", "a"), ("2", "+2", "2", "2 €", ""), ("-1500", "-1500", "-1,500", "-1.500 €", "z")]
    assert [r[0] for r in rows.select(exprs.safe_file_name(F.lit("a b/c-d.é_1"))).distinct().collect()] == ["a_b_c-d.é_1"]


def test_churn_sentences(spark):
    account = spark.createDataFrame([("k", 90.0, 100.0, 1, "Pumpen", 5.04)], "kunde_id string, umsatz_ytd double, umsatz_vorjahr double, wettbewerber_aktiv int, wettbewerber_produktgruppe string, preisanpassung_pct double")
    empty = [F.lit(None).cast("double").alias(c) for c in "bestellungen_ytd bestellungen_vorjahr tage_seit_letztem_einkauf produkte_aktuell produkte_vorjahr service_faelle service_faelle_vorjahr reklamationen reklamationen_vorjahr ansprechpartner_wechsel zahlungsverzug_tage mahnungen angebote_ytd angebote_vorjahr kontakte_ytd kontakte_vorjahr".split()]
    account = account.select("*", *empty)
    said = {r.key: (r.wert, r.text) for r in churn.sentences(account).collect()}
    assert said["umsatz"] == ("-10 %", "Umsatz -10 % gegenüber Vorjahr (10 € Rückgang).")
    assert said["wettbewerb"] == ("Pumpen", "Wettbewerber gewinnt Anteile in der Produktgruppe „Pumpen“.")
    assert said["preis"][0] == "+5.0 %" and said["zahlung"][1] == "Zahlungsverhalten unauffällig." and len(said) == 11
    row = one(churn.scored(account))
    assert row.aktion == "Produktgruppe Pumpen verteidigen" and row.detail.startswith("Wettbewerber gewinnt Anteile in Pumpen.")


def test_short_series_are_refused(spark):
    df = day_rows(spark, range(20))
    assert one(series.long_enough(df, ["key"], 21)).meldung == "Zu wenig Daten: 20 Zeilen, mindestens 21 benötigt."
    assert series.require_long(df, ["key"], 20).count() == 20
    with pytest.raises(ValueError, match="mindestens 21"):
        series.require_long(df, ["key"], 21)


def test_normalised_and_back(spark):
    df = day_rows(spark, [5.0, 7.0, 9.0, 50.0])
    assert [round(r.wert, 6) for r in series.denormalised(series.normalised(df, ["key"], 3)).orderBy("datum").collect()] == [7.0, 9.0, 50.0]


def test_temperature_prefers_what_was_measured(spark):
    df = day_rows(spark, range(3))
    live = spark.createDataFrame([(date(2024, 1, 2), 3.5), (date(2024, 1, 2), 3.0), (date(2024, 1, 3), None)], "date date, temperatur double")
    got = [r.temperatur for r in series.temperature(df, live).orderBy("datum").collect()]
    season = lambda day: 16.5 + 12.5 * math.sin((day - 80) / 365 * 2 * math.pi)
    assert got == pytest.approx([season(1), 3.5, season(3)])


def test_forecast_fills_the_gap_to_its_start(spark):
    from tallyloom.sources import generate

    df = generate.daily_sales(spark, 2, 2, 430).where("NOT (filiale = 'F0' AND datum > DATE '2025-02-25')")
    model = series.trained(df, ["filiale", "artikel"], trees=10)
    out = series.forecast(df, ["filiale", "artikel"], model, steps=2, start="2025-03-08", actions=(0, 1))
    rows = out.orderBy("filiale", "artikel", "datum").collect()
    assert [str(r.datum) for r in rows] == ["2025-03-08", "2025-03-09"] * 4 and [r.aktion for r in rows] == [0, 1] * 4
    real = {(r.filiale, r.artikel, str(r.datum)): r.menge for r in df.collect()}
    assert all(r.naiv == real[r.filiale, r.artikel, "2025-03-01"] for r in rows if r.filiale == "F1" and str(r.datum) == "2025-03-08")
    assert all(r.naiv == real[r.filiale, r.artikel, "2025-02-22"] for r in rows if r.filiale == "F0" and str(r.datum) == "2025-03-08")
    with pytest.raises(ValueError, match="120 are filled"):
        series.forecast(df, ["filiale", "artikel"], model, start="2027-01-01")


def test_generated_tables_are_the_same_again(spark):
    from tallyloom.sources import generate

    for make in (lambda seed: generate.daily_sales(spark, 2, 3, 10, seed=seed), lambda seed: generate.offers(spark, 50, seed), lambda seed: generate.companies(spark, 50, seed)):
        assert sorted(make(1).collect()) == sorted(make(1).repartition(3).collect()) != sorted(make(2).collect())
    found = resolve.duplicates(generate.companies(spark, 50)).where("score >= 0.75").collect()
    assert {(r.a_id, r.b_id) for r in found} >= {(i, i + 1) for i in range(3, 50, 5)}
    assert one(margin.kpis(margin.derive(generate.offers(spark, 200)))).total == 200


def test_running_rate(spark):
    rows = spark.createDataFrame([(i, "p", "NOK" if i in (1, 2) else "OK", float(86_400 * (i // 4) + i)) for i in range(6)], "id int, project_id string, decision string, created_at double")
    got = [(r.id, r.total, r.nok_rate, r.alarm) for r in monitor.running_rate(rows).orderBy("id").collect()]
    assert got == [(0, 1, 0.0, False), (1, 2, 50.0, True), (2, 3, 66.7, True), (3, 4, 50.0, True), (4, 1, 0.0, False), (5, 2, 0.0, False)]


def test_recommendations_by_matrix_as_by_joins(spark):
    draw = random.Random(8)
    own = spark.createDataFrame(sorted({(k, f"p{draw.randint(0, 25)}") for k in range(60) for _ in range(6)}), "kunde_id long, produkt_id string")
    pair = basket.pairs(own)
    rows = lambda most: sorted((r.kunde_id, r.produkt_id, r.score, r.rang) for r in basket.recommend(own, pair, most_products=most).collect())
    assert rows(10**6) == rows(0) and len(rows(0)) > 100
    assert basket.recommend(own.limit(0), pair.limit(0)).count() == 0


def test_evidence_goes_on_to_all_buyers(spark):
    draw = random.Random(6)
    own = {(k, f"p{draw.randint(0, 30)}") for k in range(40) for _ in range(3)} | {(k, "hot") for k in range(5, 40)}
    products = {k: {p for j, p in own if j == k} for k in range(40)}
    wanted = [(k, p) for k in range(40) for p in ("hot", "p1", "p2") if p not in products[k]] + [(6, "p7")]
    frame = lambda rows: spark.createDataFrame(sorted(rows), "kunde_id long, produkt_id string")
    want = {(k, p, j, len(products[k] & products[j]), n + 1) for k, p in wanted for n, j in enumerate([j for j in range(40) if j != k and p in products[j] and products[k] & products[j]][:3])}
    for first in (1, 4, 16):
        assert {(r.kunde_id, r.produkt_id, r.anderer, r.gemeinsam, r.nr) for r in basket.evidence(frame(own), frame(set(wanted)), first=first).collect()} == want


def test_explanations_by_brute_force(spark):
    draw = random.Random(2)
    own = {(k, f"p{draw.randint(0, 11)}") for k in range(25) for _ in range(5)}
    rows = spark.createDataFrame([(k, p, 1.0) for k, p in own], "kunde_id long, produkt_id string, umsatz double")
    products = {k: {p for j, p in own if j == k} for k in range(25)}
    wanted = [(k, p) for k in range(0, 25, 3) for p in ("p0", "p5", "p9", "none") if p not in products[k]]
    got = {(r.kunde_id, r.produkt_id): r for r in recommend.explain(rows, spark.createDataFrame(wanted, "kunde_id long, produkt_id string")).collect()}
    assert set(got) == set(wanted)
    for k, p in wanted:
        others = [j for j in products if j != k and p in products[j]]
        near = sorted((-round(len(products[k] & products[j]) / len(products[k] | products[j]), 4), -len(products[k] & products[j]), j) for j in others if products[k] & products[j])[:3]
        counts = {}
        for *_, j in near:
            for x in sorted(products[k] & products[j]):
                counts[x] = counts.get(x, 0) + 1
        r = got[k, p]
        assert (r.n_kunden, r.bruecke) == (len(others), max(counts, key=counts.get) if counts else None)
        assert r.belege == (", ".join(str(j) for *_, j in near) or None)


def test_configurations(spark):
    parts = spark.createDataFrame(
        [("B1", "Basis", 100, 50, "A1, A2,X9"), ("A1", "Antrieb", 50, 20, "S1"), ("A2", "Antrieb", 60, 30, ""), ("S1", "Steuerung", 40, 10, "G1"), ("G1", "Gehäuse", 30, 10, "Z3"), ("Z1", "Zubehör", 10, 5, "B1"), ("Z2", "Zubehör", 20, 5, "A1"), ("Z3", "Zubehör", 99, 5, None), ("Z4", "Zubehör", 15, 5, "S1")],
        "komponente_id string, kategorie string, listenpreis int, herstellkosten int, kompatibel_mit string",
    )
    past = spark.createDataFrame([("o1", 1, "B1,A1"), ("o2", 0, "B1, S1,Z9"), ("o3", 1, "B1")], "angebot_id string, gewonnen int, konfiguration string")
    r = one(configure.scored(parts, past))
    assert (r.c1, r.c2, r.c3, r.c4, r.preis, r.kosten, r.win_prob) == ("B1", "A1", "S1", "G1", 255.0, 100.0, 0.5)
    assert r.marge_pct == 60.8 and r.score == 30.39
    assert one(configure.scored(parts, past.limit(0))).win_prob == 0.45


def test_companies(spark):
    rows = spark.createDataFrame(
        [("1", "Wagner Pumpen GmbH", "01067", "Dresden", "Bau"), ("2", "Wagner Pumpen AG", "01067", "Dresden", "Bau"), ("3", "Wagnerr Pumpen", "99999", "Ulm", "IT"), ("4", "Zeta KG", "01099", "Dresden", "Bau"), ("5", "Omega", None, None, None)],
        "firma_id string, firma_name string, plz string, ort string, branche string",
    )
    pairs = {(r.a_id, r.b_id): r for r in resolve.reason(resolve.duplicates(rows)).collect()}
    assert pairs["1", "2"].score == 1.0 and pairs["1", "2"].ampel == "rot" and "gleiche Adresse" in pairs["1", "2"].grund
    want = SequenceMatcher(None, "wner pumpen", "wnerr pumpen").ratio()
    assert pairs["1", "3"].name_score == round(want, 4) and ("1", "5") not in pairs
    assert [r.firma_id for r in resolve.search(rows, "wagner pumpen").collect()][:2] == ["1", "2"]
    assert resolve.duplicates(rows.limit(0)).count() == 0


def test_pagerank_keeps_its_mass_and_mixes(spark):
    rows = spark.createDataFrame([(1, "A", 3.0), (1, "B", 1.0), (2, "B", 2.0), (2, "C", 2.0), (3, "C", 0.0)], "kunde_id int, produkt_id string, umsatz double")
    edges = graph.purchase_edges(rows)
    ranks = graph.personalised_pagerank(edges, spark.createDataFrame([("k:1",)], "start string"), 11)
    assert one(ranks.agg(F.sum("score")))[0] == pytest.approx(1.0)
    direct = {r.node[2:]: r.score for r in ranks.collect() if r.node.startswith("p:")}
    mixed = {r.produkt: r.ppr for r in recommend.customer_ranks(rows, 10).collect() if r.kunde == "1"}
    assert mixed == pytest.approx(direct)


def test_pushed_ranks_stay_within_the_mass_left_over(spark):
    """A ring of many groups: the scores are as near as the rest says, and far fewer of them are ever touched."""
    rng = random.Random(6)
    n = 240
    links = {(i, (i + 1) % n) for i in range(n)} | {(8 * (i // 8) + rng.randrange(8), i) for i in range(n)}
    links = {(f"n{a}", f"n{b}", float(1 + (a * b) % 3)) for a, b in links if a != b}
    rows = sorted(links | {(b, a, w) for a, b, w in links})
    edges = spark.createDataFrame([*rows, ("x", "x2", 1.0)], "src string, dst string, weight double")
    starts = spark.createDataFrame([("n0",), ("n77",), ("lone",), ("n77",), ("x",)], "start string")
    names = sorted({a for a, _, _ in rows})
    step = np.zeros((len(names), len(names)))
    for a, b, w in rows:
        step[names.index(a), names.index(b)] += w
    limit = 0.15 * np.linalg.inv(np.eye(len(names)) - 0.85 * step / step.sum(axis=1, keepdims=True))
    full = {(s, k): limit[names.index(s), i] for s in ("n0", "n77") for i, k in enumerate(names)} | {("lone", "lone"): 1.0}
    for tolerance in (0.2, 0.02):
        scores, rest = graph.pushed_pagerank(edges, starts, tolerance)
        got = {(r.start, r.node): r.score for r in scores.collect()}
        left = {r.start: r.rest for r in rest.collect()}
        assert set(left) == {"n0", "n77", "lone", "x"} and all(v <= tolerance for v in left.values())
        for start in ("n0", "n77", "lone"):
            gap = sum(abs(full.get((start, k), 0) - got.get((start, k), 0)) for k in {k for s, k in {*full, *got} if s == start})
            assert gap == pytest.approx(left[start], abs=1e-6)
        assert got["lone", "lone"] == pytest.approx(1.0)
        assert len(got) < 0.5 * len(full)


def test_customer_ranks_by_push(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([(k, f"p{rng.randrange(40)}", float(rng.randrange(1, 9))) for k in range(60) for _ in range(4)], "kunde_id int, produkt_id string, umsatz double")
    exact, pushed = ({(r.kunde, r.produkt): r.ppr for r in recommend.customer_ranks(rows, *how).collect()} for how in ((60,), (None, 1e-2)))
    for k in range(60):
        gap = sum(abs(exact[key] - pushed.get(key, 0)) for key in exact if key[0] == str(k))
        assert gap < 1.01e-2


def test_low_rank_as_numpy(spark):
    draw = np.random.default_rng(0)
    matrix = draw.integers(0, 50, (8, 6)).astype(float)
    rows = [(i, f"p{j}", float(matrix[i, j])) for i in range(8) for j in range(6) if matrix[i, j]]
    got = {(r.kunde_id, r.produkt_id): r.svd for r in recommend.low_rank(spark.createDataFrame(rows, "kunde_id int, produkt_id string, umsatz double")).collect()}
    x = np.log1p(matrix)
    mean = x.mean(axis=1, keepdims=True)
    u, s, v = np.linalg.svd(x - mean, full_matrices=False)
    want = (u[:, :4] * s[:4]) @ v[:4] + mean
    assert all(got[i, f"p{j}"] == pytest.approx(want[i, j]) for i in range(8) for j in range(6))


@pytest.mark.parametrize(("customers", "products"), [(400, 60), (30, 300), (3, 9)])
def test_singular_vectors_as_numpy(spark, customers, products):
    """Values and vectors to 1e-6 from passes over sparse rows; the sketch never has products squared cells."""
    draw = np.random.default_rng(3)
    matrix = np.where(draw.random((customers, products)) < 0.2, draw.integers(1, 900, (customers, products)), 0).astype(float)
    matrix[:, 0] = draw.integers(1, 9, customers)  # every product has a number if any customer bought it
    matrix[0] = np.maximum(matrix[0], 1)
    rows = [(i, j, float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))]
    frame = spark.createDataFrame([(int(i), f"p{j:04}", u) for i, j, u in rows], "kunde_id int, produkt_id string, umsatz double").repartition(5)
    names, _, vectors, _ = recommend.factors(frame)
    k = min(4, customers - 1)
    values, right = recommend.singular(vectors, len(names), k)
    x = np.log1p(matrix)
    _, s, v = np.linalg.svd(x - x.mean(axis=1, keepdims=True), full_matrices=False)
    assert np.allclose(values, s[:k], rtol=1e-8)
    assert np.allclose(np.abs(np.sum(right * v[:k].T, axis=0)), 1, atol=1e-10) and np.allclose(right * np.sign(np.sum(right * v[:k].T, axis=0)), v[:k].T, atol=1e-6)


def test_hybrid_of_a_catalogue_above_20000_products(spark):
    rows = [(k, f"p{(21 * k + j) % 20_500:05}", float(1 + (k * j) % 7)) for k in range(1_000) for j in range(23)]
    got = recommend.hybrid(spark.createDataFrame(rows, "kunde_id int, produkt_id string, umsatz double").repartition(8), iterations=2, top=2).collect()
    owned = {(k, p) for k, p, _ in rows}
    assert len({p for _, p in owned}) > 20_000
    assert {(r.kunde_id, r.rang) for r in got} == {(k, n) for k in range(1_000) for n in (1, 2)} and not {(r.kunde_id, r.produkt_id) for r in got} & owned


def test_communities(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    got = {r.node: r.community for r in graph.communities(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got["a"] == got["b"] == got["c"] != got["x"] == got["y"] == got["z"]


def day_rows(spark, values, start=date(2024, 1, 1), skip=()):
    rows = [("s", date.fromordinal(start.toordinal() + i), float(v)) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "key string, datum date, menge double")


def test_series(spark):
    df = day_rows(spark, range(40), skip=(20,))
    got = {r.datum.toordinal() - date(2024, 1, 1).toordinal(): r for r in series.features(df, ["key"]).collect()}
    assert got[6].roll_mean_28 is None and got[6].roll_std_28 == 0.0 and got[7].roll_mean_28 == 3.0
    assert got[21].lag_7 == 13.0 and got[7].roll_std_28 == pytest.approx(np.std(range(7), ddof=1))
    back = {r.datum.toordinal() - date(2024, 1, 1).toordinal(): r for r in series.calendar_lags(df, ["key"]).collect()}
    assert back[21].vor_7 == 14.0 and back[27].vor_7 == pytest.approx(sum(x for x in range(40) if x != 20) / 39)
    naive = {r.datum.toordinal() - date(2024, 1, 1).toordinal(): r.naiv for r in series.naive_baseline(df, ["key"]).collect()}
    assert naive[27] == 13.0 and naive[28] == 21.0 and naive[3] is None
    full = series.filled(series.complete(df, ["key"]), ["key"])
    assert full.count() == 40 and one(full.where("menge IS NULL")).gefuellt == 19.0


def test_flags_and_corrections(spark):
    df = spark.createDataFrame([("s", date(2024, 1, 1), 18.0, 10.0, 2.0), ("s", date(2024, 1, 2), 18.1, 10.0, 2.0), ("s", date(2024, 1, 3), 5.0, 0.0, 9.0)], "key string, datum date, prognose double, naiv double, roll_std_28 double")
    got = series.flags(series.interval(df)).orderBy("datum").collect()
    assert [r.flag for r in got] == ["ok", "auffaellig", "ok"] and (got[0].unten, got[0].oben) == (15.0, 21.0) and got[2].unten == 0.0
    fixes = spark.createDataFrame([("s", date(2024, 1, 1), 7), ("s", date(2024, 1, 2), None)], "key string, datum date, wert int")
    assert [r.final for r in series.corrected(df, fixes, ["key"]).orderBy("datum").collect()] == [7.0, 18.1, 5.0]


def test_backtest_needs_a_week(spark):
    rows = [("s", date(2024, 1, 1 + i), 10.0, 12.0, 15.0) for i in range(6)] + [("t", date(2024, 1, 1 + i), 10.0, 12.0, 15.0) for i in range(7)]
    got = {r.key: r for r in series.backtest(spark.createDataFrame(rows, "key string, datum date, menge double, prognose double, naiv double"), ["key"]).collect()}
    assert got["s"].wape is None and (got["t"].wape, got["t"].wape_naiv, got["t"].bias) == (0.2, 0.5, 2.0) and got["t"].verbesserung_pct == pytest.approx(60.0)


def test_forecast_follows_a_weekly_pattern(spark):
    df = day_rows(spark, [10 + 40 * (i % 7 == 5) for i in range(210)])
    out = series.forecast(df, ["key"], series.trained(df, ["key"])).orderBy("datum").collect()
    want = [10 + 40 * (i % 7 == 5) for i in range(210, 217)]
    assert len(out) == 7 and sum(abs(r.prognose - w) for r, w in zip(out, want)) / sum(want) < 0.15


def test_holidays(spark):
    df = day_rows(spark, range(4))
    days = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 1),)], "date date")
    ranges = spark.createDataFrame([(date(2024, 1, 2), date(2024, 1, 3)), (date(2024, 1, 3), date(2024, 1, 3))], "start date, end date")
    assert [(r.feiertag, r.ferien) for r in series.holidays(df, days, ranges).orderBy("datum").collect()] == [(1, 0), (0, 1), (0, 1), (0, 0)]


def test_horizons():
    assert series.horizon("h", "3m") == 720 and series.horizon("D", "2w") == 14


def test_ensemble(spark):
    rows = [(s, datetime(2024, 1, d, h), float(s)) for s in range(1, 12) for d in (1, 2) for h in (0, 12)]
    days = ensemble.daily(spark.createDataFrame(rows, "sample_id int, ts timestamp, value double"))
    r = one(days.where("tag = '2024-01-01'"))
    assert (r["mean"], r.q10, r.q90) == (12.0, 4.0, 20.0)
    p = one(ensemble.plan(days))
    assert (p.summe, p.sicher, p.gebinde, p.bester_tag) == (24.0, pytest.approx(44.0), 1, date(2024, 1, 2))
    draws = ensemble.bootstrap(day_rows(spark, [i % 7 for i in range(70)]), ["key"], 7, samples=5)
    assert {(r.step, r.value) for r in draws.collect()} == {(s, float((69 + s) % 7)) for s in range(1, 8)}


def test_nearest_in_blocks(spark):
    draw = np.random.default_rng(0)
    points = draw.normal(size=(60, 4))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id int, embedding array<double>")
    bank = df.where("vec_id < 20")
    want = {i: float(np.sqrt(((points[i] - points[:20]) ** 2).sum(axis=1)).min()) for i in range(60)}
    for most in (50_000, 7):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(metric.blocks, "__defaults__", (most,))
            assert {r.vec_id: r.distance for r in anomaly.nearest(df, bank).collect()} == pytest.approx(want)
    assert one(anomaly.nearest(df, bank.limit(0)).limit(1)).distance is None


def test_metrics(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1)]
    r = one(anomaly.metrics(spark.createDataFrame(rows, "s double, y int"), "y", "s", 0.8))
    assert r.auc == pytest.approx((2 + 1.5 + 0) / 6) and (r.precision, r.recall, r.f1) == (1.0, pytest.approx(1 / 3), 0.5)
    assert r.ap == pytest.approx((1 + 2 / 3 + 3 / 5) / 3, abs=1e-9)


def test_coreset(spark):
    df = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate((0, 1, 10, 11, 5))], "vec_id int, embedding array<double>")
    assert sorted(r.vec_id for r in anomaly.coreset(df, 0.6).collect()) == [0, 3, 4]


def test_monitor(spark):
    rows = [(str(i), "p", 0.1 * i, "NOK" if i > 6 else "OK", 100.0, 1_000_000.0 - i * 3600) for i in range(10)]
    df = spark.createDataFrame(rows, "id string, project_id string, anomaly_score double, decision string, inference_ms double, created_at double")
    s = one(monitor.stats(df))
    assert (s.total, s.nok, s.nok_rate, s.avg_score, s.avg_ms) == (10, 3, 30.0, 0.45, 100.0)
    empty = one(monitor.stats(df.limit(0)))
    assert (empty.total, empty.nok_rate, empty.avg_score) == (0, 0.0, 0.0)
    trend = {r.tag: r.total for r in monitor.daily_trend(df, 1_000_000.0).collect()}
    assert trend == {0: 10} | dict.fromkeys(range(1, 7), 0)
    on_edge = monitor.daily_trend(df.limit(1).withColumn("created_at", F.lit(1_000_000.0 - 86_400)), 1_000_000.0)
    assert {r.tag for r in on_edge.collect() if r.total} == {1}
    assert [r.nok_rate for r in monitor.alerts(df).collect()] == [30.0]


def test_reconstruction_error_as_numpy(spark):
    x = np.random.default_rng(0).normal(size=(40, 6)) * np.array([5, 4, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id int, embedding array<double>")
    centred = x - x.mean(axis=0)
    v = np.linalg.svd(centred, full_matrices=False)[2][:3]
    want = ((centred - centred @ v.T @ v) ** 2).sum(axis=1)
    got = {r.vec_id: r.score for r in anomaly.reconstruction_scores(df, 3).collect()}
    assert [got[i] for i in range(40)] == pytest.approx(want.tolist())


def test_hybrid_leaves_out_what_is_owned(spark):
    rows = [(c, f"p{p}", float(1 + (c * 7 + p) % 5)) for c in range(6) for p in range(6) if (c + p) % 3]
    df = spark.createDataFrame(rows, "kunde_id int, produkt_id string, umsatz double")
    got = recommend.hybrid(df, iterations=4).collect()
    assert {(r.kunde_id, r.produkt_id) for r in got} == {(c, f"p{p}") for c in range(6) for p in range(6)} - {(c, p) for c, p, _ in rows}
    assert all(45 <= r.match <= 97 and 0 <= r.hybrid <= 1 for r in got) and all(r.match == 97 for r in got if r.rang == 1)


SMALL = "/root/testdata/sf0.001"


def test_hybrid_query_knows_the_purchases_of_all_years(spark):
    bought = {(r.kunde_id, r.produkt_id) for r in catalog.purchases(spark, SMALL).where("umsatz > 0").select("kunde_id", "produkt_id").distinct().collect()}
    got = {(r.kunde_id, r.produkt_id) for r in catalog.recommend_hybrid(spark, SMALL).collect()}
    assert {k for k, _ in got} == {k for k, _ in bought} and not got & bought


def test_communities_query_reads_all_years(spark):
    buyers, customers = {}, set()
    for r in catalog.purchases(spark, SMALL).where("umsatz > 0").select("kunde_id", "produkt_id").distinct().collect():
        buyers.setdefault(r.produkt_id, set()).add(r.kunde_id)
        customers.add(r.kunde_id)
    names = sorted(buyers)
    both = {(a, b): len(buyers[a] & buyers[b]) * len(customers) / (len(buyers[a]) * len(buyers[b])) for a in names for b in names if a < b and buyers[a] & buyers[b]}
    linked = sorted(k for k, lift in both.items() if round(lift, 2) > 1)
    nodes = sorted({x for k in linked for x in k})
    at = {n: i for i, n in enumerate(nodes)}
    label = graph.greedy_modularity(len(nodes), [(at[a], at[b]) for a, b in linked])
    want = {frozenset(n for n in nodes if label[at[n]] == c) for c in set(label)}
    got = {}
    for r in catalog.communities(spark, SMALL).collect():
        got.setdefault(r.community, set()).add(r.node)
    assert {frozenset(x) for x in got.values()} == want


def test_communities_are_the_same_method_beyond_200000_edges(spark):
    pairs = [(a, b) for a in range(640) for b in range(a + 1, 640)] + [(i, i + 1) for i in range(640, 680)]
    label = graph.greedy_modularity(681, pairs)
    frame = spark.createDataFrame(pd.DataFrame([(f"{a:04}", f"{b:04}") for a, b in pairs], columns=["src", "dst"]))
    assert {r.node: r.community for r in graph.communities(frame).collect()} == {f"{i:04}": f"{c:04}" for i, c in enumerate(label)}


def test_greedy_modularity_joins_the_best_pair(spark):
    draw = np.random.default_rng(1)
    for nodes in (6, 15, 30):
        pairs = sorted({(int(min(p)), int(max(p))) for p in draw.integers(0, nodes, (nodes * 2, 2)) if p[0] != p[1]})
        m, degree = len(pairs), [sum(i in p for p in pairs) for i in range(nodes)]
        sets = {i: {i} for i in range(nodes)}
        while True:
            gains = [(-2 * m * n + sum(degree[i] for i in sets[a]) * sum(degree[i] for i in sets[b]), a, b) for a in sets for b in sets if a < b and (n := sum((x in sets[a] and y in sets[b]) or (y in sets[a] and x in sets[b]) for x, y in pairs))]
            if not gains or min(gains)[0] >= 0:
                break
            _, a, b = min(gains)
            sets[a] |= sets.pop(b)
        want = {i: c for c, x in sets.items() for i in x}
        assert graph.greedy_modularity(nodes, pairs) == [want[i] for i in range(nodes)]


def test_coreset_is_a_tenth_of_many_vectors(spark):
    x = np.random.default_rng(2).random((20_500, 2))
    got = {r.vec_id for r in anomaly.coreset(spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))).collect()}
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < 2050:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    assert got == set(chosen) and len(got) == 2050
    copies = spark.createDataFrame([(i, [float(i // 5)]) for i in range(10)], "vec_id int, embedding array<double>")
    assert sorted(r.vec_id for r in anomaly.coreset(copies, 0.4).collect()) == [0, 1, 2, 5]


def grouped_vectors(n, groups=40, width=6, seed=4):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 10, (groups, width))
    return [(i, [float(v) for v in middles[i % groups] + rng.normal(0, 0.3, width)]) for i in range(n)]


def test_blocks_far_away_are_never_compared(spark):
    rows = grouped_vectors(4000)
    vectors = spark.createDataFrame([*rows, (4000, rows[0][1]), (4001, [50.0] * 6), (4002, None)], "vec_id long, embedding array<double>")
    bank = vectors.where("vec_id % 3 = 0 AND vec_id < 4000")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(metric.blocks, "__defaults__", (32,))
        m.setattr(metric, "SIZE", 16)
        found, pairs = metric.nearest(vectors, bank, "vec_id", "embedding")
        got = {r.vec_id: r.distance for r in found.collect()}
    x, y = np.array([v for _, v in rows]), np.array([v for i, v in rows if i % 3 == 0])
    want = np.sqrt(((x[:, None] - y) ** 2).sum(axis=2).min(axis=1))
    assert len(got) == 4002 and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in range(4000)) and got[4000] == 0
    every = -(-4000 // 32) * -(-len(y) // 32)
    assert pairs.distinct().count() == pairs.count() < 0.25 * every


@pytest.mark.parametrize("kind", ["groups", "plane", "grid", "copies", "names"])
def test_coreset_as_one_by_one(spark, kind):
    """Many choices a round, the very same as the sequential rule gives, ties and copies included."""
    rng = np.random.default_rng(3)
    x = {"groups": np.array([v for _, v in grouped_vectors(3000)]), "plane": rng.random((3000, 2)), "grid": rng.integers(0, 12, (1500, 2)).astype(float), "copies": np.repeat(rng.random((150, 3)), 8, axis=0), "names": rng.random((600, 3))}[kind]
    ids = [f"n{i:05}" for i in range(len(x))] if kind == "names" else list(range(len(x)))
    frame = spark.createDataFrame(list(zip(ids, x.tolist())), f"vec_id {'string' if kind == 'names' else 'long'}, embedding array<double>").repartition(6)
    want = max(1, int(len(x) * (0.4 if kind == "copies" else 0.1)))
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < want:
        far[chosen[-1]] = -1
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(metric.blocks, "__defaults__", (128,))
        m.setattr(metric, "SIZE", 128)
        found, rounds = metric.farthest_first(frame, want, "vec_id", "embedding")
        assert sorted(r.vec_id for r in found.collect()) == sorted(ids[i] for i in chosen)
    assert rounds - 2 <= want / 10


def test_recommendations_of_many_products_are_joined(spark, monkeypatch):
    """A catalogue whose square no task could hold, in a hundred thousand pairs of their own."""
    monkeypatch.setattr(basket, "_recommend_by_matrix", None)
    own = spark.range(200_000).select((F.col("id") / 2).cast("long").alias("kunde_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("produkt_id"))
    own = own.unionByName(spark.createDataFrame([(-1, "p0"), (-2, "p2")], "kunde_id long, produkt_id string"))
    got = {(r.kunde_id, r.produkt_id, r.rang) for r in basket.recommend(own, basket.pairs(own)).collect()}
    assert got == {(-1, "p1", 1), (-2, "p3", 1)}


@pytest.mark.parametrize("by", [["g"], ["g", "h"], []])
def test_quantiles_as_percentile(spark, by):
    """Ties, nulls, NaN, infinities, signed and tiny values, groups of one, of nulls and of nearly all rows."""
    rng = random.Random(7)
    odd = [None, 0.0, -0.0, float("nan"), float("inf"), float("-inf"), 1e-310, -1e300, 5e-324, 1e300]
    rows = [(rng.choice(["a"] * 8 + ["b", "c", None]), rng.randrange(2), rng.choice([rng.gauss(0, 1), round(rng.random(), 1), 100 + rng.random() / 1e9, float(rng.randrange(5)), -rng.random() * 1e6])) for _ in range(6000)]
    rows += [("odd", 1, v) for v in odd] + [("one", 0, 3.5), ("none", 0, None), ("none", 1, None)]
    rows = rows if by else [r for r in rows if r[2] is None or math.isfinite(r[2])]
    frame = spark.createDataFrame(rows, "g string, h int, x double").repartition(5)
    shares = {"q0": 0.0, "q10": 0.1, "mid": 0.5, "q95": 0.95, "q333": 1 / 3, "top": 1.0}
    plain = lambda r: tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)
    got = sorted((plain(r) for r in quantile.quantiles(frame, by, "x", shares).collect()), key=str)
    want = frame.groupBy(*by).agg(*[F.percentile("x", F.lit(s)).alias(n) for n, s in shares.items()])
    want = sorted((plain(r) for r in want.collect()), key=str)
    assert [r[: len(by)] for r in got] == [r[: len(by)] for r in want]
    for g, w in zip(got, want):
        assert all(a == b or None not in (a, b) and "nan" not in (a, b) and a == pytest.approx(b, rel=1e-12) for a, b in zip(g[len(by) :], w[len(by) :])), (g, w)


def test_moved_communities_are_as_good_as_greedy_ones(spark):
    rng = random.Random(12)
    pairs = [(f"n{a:03}", f"n{b:03}") for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.7 if a // 10 == b // 10 else 0.03)] + [("q", "q")]
    frame = spark.createDataFrame(pairs, "src string, dst string").coalesce(2)
    links = frame.where("src <> dst")
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    found = graph.moved_communities(frame, most_rounds=8)
    assert {r.node for r in found.collect()} == {x for p in pairs for x in p} - {"q"}
    assert graph.modularity(both, found) >= graph.modularity(both, graph.communities(links)) - 0.02
    assert graph.moved_communities(frame.limit(0)).count() == 0


def test_autoencoder_gradient():
    draw = np.random.default_rng(1)
    x, flat = draw.normal(size=(7, 3)), draw.normal(size=sum(int(np.prod(s)) for s in autoencoder.shapes(3, 4, 2)))
    error = lambda p: 0.5 * ((autoencoder.rebuilt(x, autoencoder.unpacked(p, 3, 4, 2))[0] - x) ** 2).sum() / len(x)
    got = autoencoder.gradient(x, autoencoder.unpacked(flat, 3, 4, 2))
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert got[i] == pytest.approx((error(flat + step) - error(flat - step)) / 2e-6, abs=1e-6)


def test_autoencoder_beats_components_on_curved_data(spark):
    """Points of a curve need one number each, but no straight line; what is off the curve scores high, and layout changes nothing."""
    draw = np.random.default_rng(2)
    t = draw.uniform(-1, 1, 900)
    x = np.stack([t, 2 * t**2, t**3, 1 - t**2], axis=1) + draw.normal(0, 0.02, (900, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0, 2.0, 0.0, -1.0]), (901, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in autoencoder.scores(frame.repartition(5), code=1).collect()}
    straight = {r.vec_id: r.score for r in anomaly.reconstruction_scores(frame.where("embedding IS NOT NULL"), k=1).collect()}
    assert set(got) == set(range(901)) and sum(got[i] for i in range(900)) < 0.3 * sum(straight[i] for i in range(900))
    assert got[900] > 5 * sorted(got[i] for i in range(900))[855]
    again = {r.vec_id: r.score for r in autoencoder.scores(frame.repartition(2), code=1, rounds=2).collect()}
    assert again == pytest.approx({r.vec_id: r.score for r in autoencoder.scores(frame.coalesce(1), code=1, rounds=2).collect()}, rel=1e-6)
    assert autoencoder.scores(frame.limit(0)).count() == 0


def made_up_companies(n, seed=1):
    """Names of many first letters, towns that are alike or not, codes in many areas, copies with slips, and rows with empty fields."""
    rng = random.Random(seed)
    syllables = "ba chor dre fen gul hax in jo kel lum mo nert os pri qua rost sti tev ul vor wam xi yel zor".split()
    word = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    towns = ["Neustadt", "Neustatt", "Altstadt", "Ulm", "Ulmen", "Köln", "Hof", "Berlin", "Bernau", "Mainz"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.2:
            _, name, code, town, branch = rng.choice(rows)
            name = name and name[: rng.randrange(1, len(name) + 1)] + rng.choice(["", "x", "en"]) + name[rng.randrange(len(name)) :]
            row = (name, rng.choice([code, f"{rng.randrange(10000, 99999)}"]), rng.choice([town, rng.choice(towns)]), rng.choice([branch, "IT"]))
        else:
            row = (f"{word(rng.randrange(1, 4)).title()} {word(2).title()}{rng.choice([' GmbH', ' KG', '', ' & Co.'])}", f"{rng.randrange(10000, 99999)}", rng.choice(towns), rng.choice(["IT", "Bau", "Handel"]))
        row = tuple(None if rng.random() < 0.03 else "" if rng.random() < 0.02 else v for v in row)
        rows.append((i, *row))
    return rows


COMPANY = "firma_id long, firma_name string, plz string, ort string, branche string"


def brute_duplicates(rows, similar):
    """Every candidate pair scored: (a, b) to score."""
    out = {}
    for a, b in itertools.combinations(rows, 2):
        if not (a.area and a.area == b.area or a.letter and a.letter == b.letter):
            continue
        place = 0.6 * (1.0 if a.plz == b.plz else 0.5 if a.area == b.area else 0.0) + 0.4 * similar(a.ort, b.ort)
        score = round(0.6 * similar(a.name, b.name) + 0.3 * place + 0.1 * (a.branche == b.branche), 4)
        if score >= 0.55:
            out[a.firma_id, b.firma_id] = score
    return out


def plain_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0


@pytest.mark.parametrize(("similar", "plain"), [(resolve.ratio, lambda a, b: SequenceMatcher(None, a, b).ratio()), (resolve.edit_ratio, plain_edit)])
def test_duplicates_by_bounds_are_all_pairs_above_the_limit(spark, similar, plain):
    frame = spark.createDataFrame(made_up_companies(260), COMPANY)
    rows = sorted(resolve.prepared(frame).collect(), key=lambda r: r.firma_id)
    want = brute_duplicates(rows, plain)
    got = {(r.a_id, r.b_id): r.score for r in resolve.duplicates(frame, similar).collect()}
    assert set(got) == set(want) and len(got) > 30
    assert all(abs(got[k] - want[k]) < 2e-4 for k in got)


def test_few_pairs_survive_the_bounds(spark):
    """Most pairs of a block never meet the string function; a hot key is dealt over several tasks."""
    frame = spark.createDataFrame(made_up_companies(3000, 2), COMPANY)
    rows = resolve.prepared(frame).cache()
    block = resolve.candidates(rows).count()
    kept = resolve.survivors(rows, resolve.ratio, resolve.most_ratio, resolve.YELLOW).join(resolve.candidates(rows), ["a_id", "b_id"]).count()
    assert len({r.letter for r in rows.select("letter").distinct().collect()}) > 15
    assert kept < 0.1 * block, (kept, block)
    found = resolve.duplicates(frame, resolve.edit_ratio).collect()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(resolve, "ROWS_OF_KEY", 50)
        assert sorted(resolve.duplicates(frame, resolve.edit_ratio).collect()) == sorted(found)


def test_candidates_are_distinct_without_comparing_pairs(spark):
    """Ids that several rows have may repeat pairs, others can't: the pairs of those are not sorted out."""
    draw = random.Random(8)
    kind = "firma_id long, area string, letter string"
    once = [(i, draw.choice(["", "10", "11"]), draw.choice(["", "a", "b"])) for i in range(40)]
    for rows in (once, once + [(i, draw.choice(["", "10", "11"]), draw.choice("ab")) for i in range(0, 40, 3)]):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] == b[1] != "" or a[2] == b[2] != "")}
        found = resolve.candidates(spark.createDataFrame(rows, kind))
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert ("keys=[a_id" in found._jdf.queryExecution().executedPlan().toString()) == (rows is not once)


def test_evidence_of_equal_sets_is_found_once(spark):
    """Blocks of product sets, and the join of large catalogues, give what comparing all customers gives, ties and owned products included."""
    draw = random.Random(9)
    products = {k: frozenset(draw.sample("abcdefgh", draw.randint(1, 4))) for k in range(30)} | {k: frozenset("abc") for k in range(30, 36)}
    wanted = [(k, p) for k in range(0, 36, 2) for p in "abh"]
    want = set()
    for k, p in wanted:
        alike = lambda j: (-round(len(products[k] & products[j]) / len(products[k] | products[j]), 4), -len(products[k] & products[j]), j)  # noqa: B023, E731
        best = sorted((j for j in products if j != k and p in products[j] and products[k] & products[j]), key=alike)[:3]
        want |= {(k, p, j, tuple(sorted(products[k] & products[j])), n + 1) for n, j in enumerate(best)}
    rows = spark.createDataFrame([(k, p, 1.0) for k in products for p in products[k]], "kunde_id long, produkt_id string, umsatz double")
    frame = spark.createDataFrame(wanted, "kunde_id long, produkt_id string")
    for bits in (1024, 4):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(recommend, "ROWS_OF_BLOCK", 7)
            if bits < 1024:
                m.setattr(recommend, "BITS", bits)
            assert {(r.kunde_id, r.produkt_id, r.anderer, tuple(r.gemeinsam), r.nr) for r in recommend.evidence(rows, frame).collect()} == want
