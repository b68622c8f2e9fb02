"""All queries of the library and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.exprs import even, exact_sum
from tallyloom.operators import actions, anomaly, basket, churn, configure, deals, ensemble, graph, margin, monitor, recommend, resolve, series
from tallyloom.plans.roles import duck_text, role
from tallyloom.sources.session import cut

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def with_roles(body: str, *roles: str, extra: str = "") -> str:
    """A SELECT over roles; extra: more common tables."""
    parts = [f"{r} AS ({duck_text(r)})" for r in roles] + ([extra] if extra else [])
    return f"WITH {', '.join(parts)} {body}"


def ev(x: str, digits: int = 0) -> str:
    """Half to even in DuckDB, as exprs.even."""
    if digits == 0:
        return f"round_even({x}, 0)"
    scale = f"CAST({10 ** abs(digits)} AS DOUBLE)"
    return f"(round_even(({x}) * {scale}, 0) / {scale})" if digits > 0 else f"(round_even(({x}) / {scale}, 0) * {scale})"


def dsum(x: str, scale: int = 4) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(28,{scale}))) AS DOUBLE)"


def dmean(x: str, scale: int = 4) -> str:
    return f"({dsum(x, scale)} / COUNT({x}))"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- margin leakage -------------------------------------------------------------------------------

PRICED = f"priced AS (SELECT *, {ev('(verkaufspreis - listenpreis * CAST(0.55 AS DOUBLE)) / verkaufspreis * 100', 1)} AS deckungsbeitrag_pct FROM offers)"
GAIN = "GREATEST(CAST(0 AS DOUBLE), umsatz * CAST(0.15 AS DOUBLE) - deckungsbeitrag_pct / 100 * umsatz)"


def summary_sql(by: str) -> str:
    leak = ev("AVG(CASE WHEN deckungsbeitrag_pct < 15 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100", 1)
    return f"SELECT {by}, {ev(dmean('rabatt_pct'), 1)} AS avg_rabatt, {ev(dmean('deckungsbeitrag_pct'), 1)} AS avg_marge, COUNT(*) AS n, {leak} AS leck_quote, {dsum('umsatz')} AS umsatz FROM priced GROUP BY {by}"


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return margin.derive(role(spark, sf_dir, "offers"))


@query(with_roles(summary_sql("segment"), "offers", extra=PRICED))
def margin_by_segment(spark, sf_dir):
    return margin.summary(offers(spark, sf_dir), "segment")


@query(with_roles(summary_sql("vertriebsmitarbeiter"), "offers", extra=PRICED))
def margin_by_rep(spark, sf_dir):
    return margin.summary(offers(spark, sf_dir), "vertriebsmitarbeiter")


@query(with_roles(summary_sql("produkt"), "offers", extra=PRICED))
def margin_by_product(spark, sf_dir):
    return margin.summary(offers(spark, sf_dir), "produkt")


@query(with_roles(summary_sql("kunde"), "offers", extra=PRICED))
def margin_by_customer(spark, sf_dir):
    return margin.summary(offers(spark, sf_dir), "kunde")


@query(
    with_roles(
        f"""SELECT {ev(dmean('rabatt_pct'), 1)} AS avg_rabatt, {ev(dmean('deckungsbeitrag_pct'), 1)} AS avg_marge,
        {ev(f"COALESCE({dsum(f'CASE WHEN deckungsbeitrag_pct < 15 THEN {GAIN} END', 8)}, 0)")} AS potenzial, COUNT(CASE WHEN deckungsbeitrag_pct < 15 THEN 1 END) AS leaks,
        COALESCE({dsum('CASE WHEN deckungsbeitrag_pct < 15 THEN umsatz END')}, 0) AS leak_volumen,
        COUNT(CASE WHEN rabatt_pct > (SELECT quantile_cont(rabatt_pct, 0.9) FROM priced) THEN 1 END) AS ausreisser, COUNT(*) AS total FROM priced""",
        "offers",
        extra=PRICED,
    )
)
def margin_kpis(spark, sf_dir):
    return margin.kpis(offers(spark, sf_dir))


@query(
    with_roles(
        f"""SELECT angebot_id, l_partkey, l_suppkey, l_linenumber, menge, umsatz, deckungsbeitrag_pct, {GAIN} AS potenzial, {ev('(CAST(15 AS DOUBLE) - deckungsbeitrag_pct) * CAST(0.9 AS DOUBLE)', 1)} AS preis_plus_pct
        FROM priced WHERE deckungsbeitrag_pct < 15 ORDER BY deckungsbeitrag_pct, angebot_id, l_partkey, l_suppkey, l_linenumber, menge, umsatz LIMIT 5""",
        "offers",
        extra=PRICED,
    )
)
def margin_top_leaks(spark, sf_dir):
    tie = ("angebot_id", "l_partkey", "l_suppkey", "l_linenumber", "menge", "umsatz")
    return margin.top_leaks(offers(spark, sf_dir), tie=tie).select(*tie, "deckungsbeitrag_pct", "potenzial", "preis_plus_pct")


@query(
    with_roles(
        """SELECT w.vertriebsmitarbeiter AS schlechtester, w.avg_rabatt AS schlechtester_rabatt, b.vertriebsmitarbeiter AS bester, b.avg_rabatt AS bester_rabatt,
        GREATEST(CAST(0 AS DOUBLE), w.umsatz * (b.avg_marge - w.avg_marge) / 100) AS potenzial
        FROM (SELECT * FROM g ORDER BY avg_rabatt DESC, vertriebsmitarbeiter DESC LIMIT 1) w, (SELECT * FROM g ORDER BY avg_rabatt, vertriebsmitarbeiter LIMIT 1) b""",
        "offers",
        extra=f"{PRICED}, g AS ({summary_sql('vertriebsmitarbeiter')})",
    )
)
def margin_rep_spread(spark, sf_dir):
    return margin.spread(margin.summary(offers(spark, sf_dir), "vertriebsmitarbeiter"), "vertriebsmitarbeiter")


# --- cross-selling --------------------------------------------------------------------------------

OWN = f"own AS (SELECT kunde_id, produkt_id, {dsum('umsatz')} AS umsatz FROM purchases GROUP BY ALL HAVING SUM(CAST(umsatz AS DECIMAL(28,4))) > 0)"
PAIRS = f"""{OWN}, single AS (SELECT produkt_id, COUNT(*) AS n FROM own GROUP BY produkt_id), tot AS (SELECT CAST(COUNT(DISTINCT kunde_id) AS DOUBLE) AS k FROM own),
both_ AS (SELECT x.produkt_id AS a, y.produkt_id AS b, COUNT(*) AS n FROM own x JOIN own y ON x.kunde_id = y.kunde_id AND x.produkt_id < y.produkt_id GROUP BY ALL),
pairs AS (SELECT a, b, both_.n AS n, {ev('both_.n / k * 100', 1)} AS support_pct, {ev('(both_.n / k) / (s.n / k) * 100', 1)} AS konfidenz_pct, {ev('(both_.n / k) / ((s.n / k) * (t.n / k))', 2)} AS lift
FROM both_ JOIN single s ON s.produkt_id = a JOIN single t ON t.produkt_id = b, tot)"""
RECOMMEND = f"""{PAIRS}, dirs AS (SELECT a, b, n, lift FROM pairs UNION ALL SELECT b, a, n, lift FROM pairs),
gain AS (SELECT kunde_id, d.b AS produkt_id, {ev(dsum('d.n * lift', 2), 2)} AS score FROM own JOIN dirs d ON d.a = own.produkt_id GROUP BY ALL),
rec AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY kunde_id ORDER BY score DESC, produkt_id) AS INT) AS rang FROM gain g WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM own o WHERE o.kunde_id = g.kunde_id AND o.produkt_id = g.produkt_id) QUALIFY rang <= 3)"""


def purchases(spark, sf_dir):
    return role(spark, sf_dir, "purchases")


def owned(rows: DataFrame) -> DataFrame:
    """What customers own, written once: pairs and recommendations read it on several sides of their joins."""
    return cut(basket.owned(rows))


@query(with_roles(f"SELECT COUNT(DISTINCT kunde_id) AS kunden, COUNT(DISTINCT produkt_id) AS produkte, COUNT(*) AS transaktionen, {dsum('umsatz')} AS umsatz FROM purchases", "purchases"))
def basket_kpis(spark, sf_dir):
    return basket.kpis(purchases(spark, sf_dir))


@query(with_roles("SELECT * FROM pairs", "purchases", extra=PAIRS))
def basket_pairs_lift(spark, sf_dir):
    return basket.pairs(owned(purchases(spark, sf_dir)))


@query(with_roles("SELECT * FROM pairs ORDER BY lift DESC, n DESC, a, b LIMIT 15", "purchases", extra=PAIRS))
def basket_top_pairs(spark, sf_dir):
    return basket.top_pairs(basket.pairs(owned(purchases(spark, sf_dir))))


@query(with_roles("SELECT kunde_id, produkt_id, score, rang FROM rec", "purchases", extra=RECOMMEND))
def basket_recommend_top3(spark, sf_dir):
    own = owned(purchases(spark, sf_dir))
    return basket.recommend(own, basket.pairs(own))


@query(with_roles(f"SELECT kunde_id, string_agg(DISTINCT produkt_id, ', ' ORDER BY produkt_id) AS produkte, COUNT(DISTINCT produkt_id) AS n_produkte, {dsum('umsatz')} AS umsatz FROM purchases GROUP BY kunde_id", "purchases"))
def customer_products(spark, sf_dir):
    return basket.customers(purchases(spark, sf_dir))


@query(with_roles(f"SELECT kunde_id, produkt_id, kategorie, COUNT(*) AS n, {dsum('umsatz')} AS umsatz FROM purchases GROUP BY ALL", "purchases"))
def customer_purchases(spark, sf_dir):
    return basket.purchases_of(purchases(spark, sf_dir))


@query(
    with_roles(
        """SELECT kunde_id, produkt_id, anderer, gemeinsam, CAST(ROW_NUMBER() OVER (PARTITION BY kunde_id, produkt_id ORDER BY anderer) AS INT) AS nr FROM (
        SELECT r.kunde_id, r.produkt_id, o.kunde_id AS anderer, COUNT(*) AS gemeinsam FROM rec r JOIN own o ON o.produkt_id = r.produkt_id AND o.kunde_id <> r.kunde_id
        JOIN own t ON t.kunde_id = o.kunde_id JOIN own m ON m.kunde_id = r.kunde_id AND m.produkt_id = t.produkt_id GROUP BY ALL) QUALIFY nr <= 3""",
        "purchases",
        extra=RECOMMEND,
    )
)
def basket_evidence(spark, sf_dir):
    own = owned(purchases(spark, sf_dir))
    return basket.evidence(own, basket.recommend(own, basket.pairs(own))).select("kunde_id", "produkt_id", "anderer", "gemeinsam", "nr")


# --- churn ----------------------------------------------------------------------------------------


def g(now: str, before: str) -> str:
    return f"(CASE WHEN CAST({before} AS DOUBLE) > 0 THEN (CAST({now} AS DOUBLE) - CAST({before} AS DOUBLE)) / CAST({before} AS DOUBLE) * 100 ELSE CAST(0 AS DOUBLE) END)"


def c01(x: str) -> str:
    return f"GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), {x}))"


SEVERITY = {
    "umsatz": c01(f"-{g('umsatz_ytd', 'umsatz_vorjahr')} / 30"),
    "bestellfreq": c01(f"-{g('bestellungen_ytd', 'bestellungen_vorjahr')} / 40"),
    "letzter_kauf": c01("(CAST(tage_seit_letztem_einkauf AS DOUBLE) - 30) / 70"),
    "wettbewerb": f"CASE WHEN wettbewerber_aktiv = 1 AND wettbewerber_produktgruppe <> 'nan' THEN CASE WHEN {g('umsatz_ytd', 'umsatz_vorjahr')} < 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END WHEN wettbewerber_aktiv = 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "portfolio": c01("GREATEST(CAST(0 AS DOUBLE), CAST(produkte_vorjahr AS DOUBLE) - produkte_aktuell) / 3"),
    "service": c01(
        f"{c01('((CASE WHEN service_faelle_vorjahr > 0 THEN CAST(service_faelle AS DOUBLE) / service_faelle_vorjahr WHEN service_faelle > 3 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) - CAST(1.2 AS DOUBLE)) / CAST(1.8 AS DOUBLE)')} * CAST(0.6 AS DOUBLE) + {c01('(CAST(reklamationen AS DOUBLE) - reklamationen_vorjahr) / 5')} * CAST(0.4 AS DOUBLE)"
    ),
    "ansprechpartner": c01("CAST(ansprechpartner_wechsel AS DOUBLE) / 3"),
    "zahlung": c01(f"{c01('CAST(zahlungsverzug_tage AS DOUBLE) / 45')} * CAST(0.6 AS DOUBLE) + {c01('CAST(mahnungen AS DOUBLE) / 3')} * CAST(0.4 AS DOUBLE)"),
    "angebote": c01(f"-{g('angebote_ytd', 'angebote_vorjahr')} / 50"),
    "preis": c01("(CAST(preisanpassung_pct AS DOUBLE) - 3) / 6"),
    "kommunikation": c01(f"-{g('kontakte_ytd', 'kontakte_vorjahr')} / 50"),
}
CHURN = (
    "sig AS ("
    + " UNION ALL ".join(f"SELECT kunde_id, umsatz_ytd, {i} AS pos, '{k}' AS key, {w} AS gewicht, {SEVERITY[k]} AS severity, {ev(f'({SEVERITY[k]}) * {w}', 2)} AS beitrag FROM accounts" for i, (k, w, _, _) in enumerate(churn.SIGNALS))
    + f"""), raw AS (SELECT kunde_id, ANY_VALUE(umsatz_ytd) AS u, LEAST(CAST(100 AS DOUBLE), list_sum(list(beitrag ORDER BY pos))) AS r, arg_max(key, beitrag * 1000000 - pos) AS dominant FROM sig GROUP BY kunde_id),
scores AS (SELECT kunde_id, {ev('r')} AS risiko, CASE WHEN r >= 65 THEN 'Kritisch' WHEN r >= 40 THEN 'Gefährdet' WHEN r >= 25 THEN 'Beobachten' ELSE 'Stabil' END AS segment, dominant,
CASE WHEN r >= 65 THEN 'innerhalb 48 h' WHEN r >= 40 THEN 'diese Woche' ELSE 'in 2 Wochen' END AS frist, {ev('u * r / 100')} AS umsatz_risiko, u FROM raw)"""
)


def churned(spark, sf_dir):
    return churn.scored(role(spark, sf_dir, "accounts"))


@query(with_roles("SELECT kunde_id, risiko, segment, dominant, frist, umsatz_risiko FROM scores", "accounts", extra=CHURN))
def churn_scores(spark, sf_dir):
    return churned(spark, sf_dir).select("kunde_id", "risiko", "segment", "dominant", "frist", "umsatz_risiko")


@query(with_roles(f"SELECT kunde_id, key, CAST(gewicht AS INT) AS gewicht, {ev('severity', 3)} AS severity, beitrag FROM sig WHERE severity >= 0.25", "accounts", extra=CHURN))
def churn_signals(spark, sf_dir):
    return churn.signals(churned(spark, sf_dir))


@query(with_roles("SELECT dominant, COUNT(*) AS n, SUM(umsatz_risiko) AS umsatz_risiko FROM scores GROUP BY dominant", "accounts", extra=CHURN))
def churn_causes(spark, sf_dir):
    return churn.causes(churned(spark, sf_dir))


@query(
    with_roles(
        f"""SELECT COUNT(*) AS kunden, COUNT(CASE WHEN segment = 'Kritisch' THEN 1 END) AS kritisch, COUNT(CASE WHEN segment = 'Gefährdet' THEN 1 END) AS gefaehrdet, COUNT(CASE WHEN segment = 'Beobachten' THEN 1 END) AS beobachten,
        SUM(umsatz_risiko) AS umsatz_risiko, {ev('AVG(risiko)', 1)} AS avg_risiko, {ev(f'SUM(umsatz_risiko) / {dsum("u")} * 100', 1)} AS risiko_quote_pct FROM scores""",
        "accounts",
        extra=CHURN,
    )
)
def churn_kpis(spark, sf_dir):
    return churn.kpis(churned(spark, sf_dir))


# --- next best action -----------------------------------------------------------------------------

GROW = g("umsatz_ytd", "umsatz_vorjahr")
D = "CAST({} AS DOUBLE)".format
FOUND = {
    "churn": (f"umsatz_vorjahr > 0 AND {GROW} <= -12", "umsatz_vorjahr - umsatz_ytd", f"LEAST({D(2)}, ABS({GROW}) / 15)"),
    "wettbewerb": ("wettbewerber_aktiv = 1", f"CASE WHEN {GROW} < 0 THEN umsatz_ytd * {D(0.35)} ELSE umsatz_ytd * {D(0.18)} END", f"CASE WHEN {GROW} < 0 THEN {D(1.6)} ELSE {D(1)} END"),
    "deal_risk": ("offene_opps > 0 AND (letzter_kontakt_tage > 25 OR opp_wert > 150000)", f"CASE WHEN letzter_kontakt_tage > 25 THEN opp_wert ELSE opp_wert * {D(0.5)} END", f"CASE WHEN letzter_kontakt_tage > 25 THEN LEAST({D(2)}, {D('letzter_kontakt_tage')} / 30) ELSE {D(0.8)} END"),
    "trigger": ("trigger_event <> '—'", f"umsatz_ytd * {D(0.3)}", D(1.5)),
    "cross_sell": ("produktluecken_wert > 0 AND portfolio_abdeckung_pct < 70", "produktluecken_wert", f"CASE WHEN {GROW} > 0 THEN {D(1.2)} ELSE {D(0.8)} END"),
    "service": (f"service_tickets_vorquartal > 0 AND service_tickets > service_tickets_vorquartal * {D(1.6)}", f"umsatz_ytd * {D(0.2)}", f"LEAST({D(1.8)}, {D('service_tickets')} / GREATEST({D('service_tickets_vorquartal')}, {D(1)}) / 2)"),
    "beziehung": (f"{D('kontakte_aktiv')} / kontakte_gesamt < {D(0.65)}", f"umsatz_ytd * {D(0.15)}", f"{D(1)} + (kontakte_gesamt - kontakte_aktiv) * {D(0.2)}"),
}
ACTIONS = (
    "sig AS ("
    + " UNION ALL ".join(f"SELECT kunde_id, vertriebsmitarbeiter, {i} AS pos, '{k}' AS key, {u} AS dr, {FOUND[k][1]} AS wert, ({FOUND[k][2]}) * {w * u} AS teil FROM accounts WHERE {FOUND[k][0]}" for i, (k, w, u, _, _) in enumerate(actions.SIGNALS))
    + f"""), agg AS (SELECT kunde_id, ANY_VALUE(vertriebsmitarbeiter) AS vertriebsmitarbeiter, list_sum(list(wert ORDER BY pos)) AS wert, list_sum(list(teil ORDER BY pos)) AS teil, CAST(MAX(dr) AS INT) AS dringlichkeit, arg_max(key, teil * 1000000 - pos) AS dominant FROM sig GROUP BY kunde_id),
raw AS (SELECT *, {ev(f'teil * (log10(GREATEST(wert, {D(1000)}) / 1000 + 1) + {D(0.4)})', 1)} AS roh FROM agg), ranked AS (SELECT *, {ev('roh / (SELECT MAX(roh) FROM raw) * 100')} AS score FROM raw)"""
)


def acted(spark, sf_dir):
    return actions.ranked(role(spark, sf_dir, "accounts"))


@query(with_roles(f"SELECT kunde_id, vertriebsmitarbeiter, {ev('wert', 4)} AS wert, roh, score, dringlichkeit, dominant FROM ranked", "accounts", extra=ACTIONS))
def actions_ranked(spark, sf_dir):
    return acted(spark, sf_dir).select("kunde_id", "vertriebsmitarbeiter", even(F.col("wert"), 4).alias("wert"), "roh", "score", "dringlichkeit", "dominant")


@query(with_roles("SELECT kunde_id, score, dringlichkeit, CAST(ROW_NUMBER() OVER (ORDER BY dringlichkeit DESC, score DESC, kunde_id) AS INT) AS rang FROM ranked ORDER BY rang LIMIT 25", "accounts", extra=ACTIONS))
def actions_top(spark, sf_dir):
    return actions.top(acted(spark, sf_dir), 25).select("kunde_id", "score", "dringlichkeit", "rang")


@query(with_roles("SELECT key AS signal, COUNT(*) AS n FROM sig GROUP BY key", "accounts", extra=ACTIONS))
def actions_signal_dist(spark, sf_dir):
    return actions.distribution(acted(spark, sf_dir))


# --- deals ----------------------------------------------------------------------------------------

DEALS = f"""ref AS (SELECT AVG(CASE status WHEN 'gewonnen' THEN {D(1)} WHEN 'verloren' THEN {D(0)} END) AS rate, MEDIAN(CASE WHEN status = 'offen' THEN tage_in_stage END) AS med FROM deals),
branch AS (SELECT branche, AVG(CASE status WHEN 'gewonnen' THEN {D(1)} ELSE {D(0)} END) AS brate FROM deals WHERE status <> 'offen' GROUP BY branche),
bc AS (SELECT opp_id, MAX(CASE WHEN rolle = 'CFO / Einkaufsleitung' THEN 1 ELSE 0 END) AS cfo, MAX(CASE WHEN rolle = 'Geschäftsführung' THEN 1 ELSE 0 END) AS gf, MAX(CASE WHEN rolle = 'Technik' THEN 1 ELSE 0 END) AS tech, SUM(wettbewerber_kontakt) AS rivals, COUNT(CASE WHEN sentiment = 'negativ' THEN 1 END) AS neg FROM contacts WHERE involviert = 1 GROUP BY opp_id),
x AS (SELECT d.*, COALESCE(cfo, 0) AS cfo, COALESCE(gf, 0) AS gf, COALESCE(tech, 0) AS tech, COALESCE(rivals, 0) AS rivals, COALESCE(neg, 0) AS neg, (COALESCE(brate, rate) - rate) * 100 AS diff, med, wettbewerber <> '—' AS rival FROM deals d LEFT JOIN bc USING (opp_id) LEFT JOIN branch USING (branche), ref WHERE status = 'offen'),
f AS (SELECT opp_id, 0 AS pos, 'Finanzfreigabe nicht eingebunden' AS titel, {D(-14)} AS delta FROM x WHERE cfo = 0 AND deal_wert >= 150000 UNION ALL SELECT opp_id, 1, 'Finanzfreigabe eingebunden', {D(8)} FROM x WHERE cfo = 1
UNION ALL SELECT opp_id, 2, 'Kein Zugang zur Geschäftsführung', {D(-7)} FROM x WHERE gf = 0 AND deal_wert >= 250000 UNION ALL SELECT opp_id, 3, 'Technische Entscheidung offen', {D(-6)} FROM x WHERE tech = 0
UNION ALL SELECT opp_id, 4, 'Wettbewerber im Buying Center aktiv', {D(-16)} FROM x WHERE rivals > 0 UNION ALL SELECT opp_id, 5, 'Wettbewerber im Rennen', {D(-6)} FROM x WHERE rivals = 0 AND rival
UNION ALL SELECT opp_id, 6, 'Deal steht still', {D(-12)} FROM x WHERE tage_in_stage > med * {D(1.8)} UNION ALL SELECT opp_id, 7, 'Kontakt eingeschlafen', {D(-10)} FROM x WHERE letzter_kontakt_tage > 30 UNION ALL SELECT opp_id, 8, 'Enger Kundenkontakt', {D(5)} FROM x WHERE letzter_kontakt_tage <= 7
UNION ALL SELECT opp_id, 9, 'Hoher Rabattdruck', {D(-8)} FROM x WHERE rabatt_gefordert_pct >= 18 UNION ALL SELECT opp_id, 10, 'Widerstand im Buying Center', {D(-9)} FROM x WHERE neg > 0 UNION ALL SELECT opp_id, 11, 'Branchen-Historie ' || branche, {ev(f'diff * {D(0.4)}')} FROM x WHERE ABS(diff) >= 8),
fs AS (SELECT opp_id, SUM(delta) AS s, arg_min(titel, delta * 1000 + pos) FILTER (delta < 0) AS top_risiko FROM f GROUP BY opp_id),
p AS (SELECT x.*, top_risiko, GREATEST({D(3)}, LEAST({D(96)}, crm_probability + COALESCE(s, 0))) AS p_graph,
GREATEST({D(4)}, LEAST({D(95)}, (tage_in_stage / GREATEST(med, 1) - 1) * 32 + 18 + letzter_kontakt_tage * {D(0.55)})) AS p_stillstand,
GREATEST({D(2)}, LEAST({D(92)}, CASE WHEN rival THEN {D(34)} ELSE {D(5)} END + CASE WHEN rivals > 0 THEN {D(26)} ELSE {D(0)} END + (rabatt_gefordert_pct - 10) * {D(0.9)})) AS p_wettbewerb,
GREATEST({D(5)}, LEAST({D(95)}, rabatt_gefordert_pct * {D(2.6)} + CASE WHEN rival THEN {D(16)} ELSE {D(0)} END + CASE WHEN rivals > 0 THEN {D(10)} ELSE {D(0)} END)) AS p_rabatt FROM x LEFT JOIN fs USING (opp_id)),
scored AS (SELECT *, CASE WHEN p_graph < crm_probability - 12 THEN 'rot' WHEN p_graph < crm_probability - 4 THEN 'gelb' ELSE 'gruen' END AS ampel, {ev('deal_wert * p_graph / 100')} AS erwartungswert FROM p)"""


def dealt(spark, sf_dir):
    return deals.scored(role(spark, sf_dir, "deals"), role(spark, sf_dir, "contacts"))


@query(with_roles(f"SELECT opp_id, p_graph, {ev('p_stillstand', 6)} AS p_stillstand, {ev('p_wettbewerb', 6)} AS p_wettbewerb, {ev('p_rabatt', 6)} AS p_rabatt, ampel, erwartungswert, top_risiko FROM scored", "deals", "contacts", extra=DEALS))
def deals_scored(spark, sf_dir):
    return dealt(spark, sf_dir).select("opp_id", "p_graph", *[even(F.col(c), 6).alias(c) for c in ("p_stillstand", "p_wettbewerb", "p_rabatt")], "ampel", "erwartungswert", "top_risiko")


@query(with_roles("SELECT opp_id, titel, delta FROM f", "deals", "contacts", extra=DEALS))
def deals_factors(spark, sf_dir):
    return deals.factors(dealt(spark, sf_dir))


@query(
    with_roles(
        f"""SELECT COUNT(*) AS deals, {dsum('deal_wert', 2)} AS pipeline, SUM(erwartungswert) AS erwartungswert, SUM({ev('deal_wert * crm_probability / 100')}) AS crm_wert,
        COUNT(CASE WHEN ampel = 'rot' THEN 1 END) AS rot, COUNT(CASE WHEN ampel = 'gelb' THEN 1 END) AS gelb, COUNT(CASE WHEN ampel = 'gruen' THEN 1 END) AS gruen FROM scored""",
        "deals",
        "contacts",
        extra=DEALS,
    )
)
def deals_kpis(spark, sf_dir):
    return deals.kpis(dealt(spark, sf_dir))


@query(
    with_roles(
        f"""SELECT o.opp_id, CAST(ROW_NUMBER() OVER (PARTITION BY o.opp_id ORDER BY ABS(h.deal_wert - o.deal_wert), CAST(h.opp_id AS VARCHAR)) AS INT) AS nr, CAST(h.opp_id AS VARCHAR) AS alt_id, h.deal_wert AS alt_wert, h.status AS alt_status, ABS(h.deal_wert - o.deal_wert) AS abstand
        FROM deals o JOIN deals h ON o.branche = h.branche AND h.status <> 'offen' WHERE o.status = 'offen' QUALIFY nr <= 5""",
        "deals",
    )
)
def deals_similar_top5(spark, sf_dir):
    rows = role(spark, sf_dir, "deals")
    return deals.similar(rows.where("status = 'offen'"), rows.where("status <> 'offen'"))


EDGES = """e AS (SELECT 'opp:' || opp_id AS src, 'kunde:' || kunde_id AS dst, 'GEHOERT_ZU' AS rel FROM deals UNION SELECT 'opp:' || opp_id, 'produkt:' || produkt_id, 'BETRIFFT' FROM deals UNION SELECT 'rep:' || vertriebsmitarbeiter, 'opp:' || opp_id, 'BETREUT' FROM deals
UNION SELECT 'rival:' || wettbewerber, 'opp:' || opp_id, 'KONKURRIERT_UM' FROM deals WHERE wettbewerber <> '—' UNION SELECT 'kontakt:' || opp_id || ':' || rolle, 'opp:' || opp_id, 'INVOLVIERT' FROM contacts WHERE involviert = 1 AND opp_id IN (SELECT opp_id FROM deals))"""


@query(with_roles("SELECT src, dst, rel FROM e", "deals", "contacts", extra=EDGES))
def deals_graph_edges(spark, sf_dir):
    return deals.graph(role(spark, sf_dir, "deals"), role(spark, sf_dir, "contacts"))


@query(with_roles("SELECT src, dst, rel FROM e WHERE src IN (SELECT src FROM e WHERE dst = 'opp:1' UNION SELECT dst FROM e WHERE src = 'opp:1' UNION SELECT 'opp:1') AND dst IN (SELECT src FROM e WHERE dst = 'opp:1' UNION SELECT dst FROM e WHERE src = 'opp:1' UNION SELECT 'opp:1')", "deals", "contacts", extra=EDGES))
def deals_ego(spark, sf_dir):
    return deals.ego(deals_graph_edges(spark, sf_dir), "opp:1")


# --- configuration --------------------------------------------------------------------------------

PAST = "past AS (SELECT DISTINCT l_orderkey AS angebot_id, p_brand AS teil, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS gewonnen FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus IN ('F', 'P'))"
CHAINS = """chain AS (SELECT a.komponente_id AS c1, b.komponente_id AS c2, c.komponente_id AS c3, d.komponente_id AS c4 FROM components a JOIN compatible e ON e.a = a.komponente_id JOIN components b ON b.komponente_id = e.b AND b.kategorie = 'Antrieb'
JOIN compatible f ON f.a = b.komponente_id JOIN components c ON c.komponente_id = f.b AND c.kategorie = 'Steuerung' JOIN compatible g ON g.a = c.komponente_id JOIN components d ON d.komponente_id = g.b AND d.kategorie = 'Gehäuse' WHERE a.kategorie = 'Basis')"""
RATED = f"""{CHAINS}, {PAST}, member AS (SELECT c1, c2, c3, c4, unnest([c1, c2, c3, c4]) AS teil FROM chain),
hit AS (SELECT c1, c2, c3, c4, angebot_id, MAX(gewonnen) AS won FROM member JOIN past USING (teil) GROUP BY c1, c2, c3, c4, angebot_id HAVING COUNT(*) >= 2),
rate AS (SELECT c1, c2, c3, c4, {ev('AVG(CAST(won AS DOUBLE))', 3)} AS win_prob FROM hit GROUP BY c1, c2, c3, c4),
rated AS (SELECT chain.*, COALESCE(win_prob, {D(0.45)}) AS win_prob FROM chain LEFT JOIN rate USING (c1, c2, c3, c4))"""
CONFIG = f"""{RATED}, acc AS (SELECT c1, c2, c3, c4, z.komponente_id AS z, z.listenpreis AS preis, z.herstellkosten AS kosten, ROW_NUMBER() OVER (PARTITION BY c1, c2, c3, c4 ORDER BY z.listenpreis DESC, z.komponente_id) AS nr
FROM (SELECT DISTINCT c1, c2, c3, c4, e.b FROM (SELECT c1, c2, c3, c4, unnest([c1, c2, c3]) AS a FROM chain) JOIN compatible e USING (a)) JOIN components z ON z.komponente_id = b AND z.kategorie = 'Zubehör' QUALIFY nr <= 2),
every AS (SELECT c1, c2, c3, c4, listenpreis AS preis, herstellkosten AS kosten FROM member JOIN components ON komponente_id = teil UNION ALL SELECT c1, c2, c3, c4, preis, kosten FROM acc),
sums AS (SELECT c1, c2, c3, c4, {dsum('preis', 2)} AS preis, {dsum('kosten', 2)} AS kosten FROM every GROUP BY c1, c2, c3, c4)"""


def past_offers(spark, sf_dir):
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem", "part")}
    rows = t["orders"].where(F.col("o_orderstatus").isin("F", "P")).join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_orderkey").alias("angebot_id")).agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("gewonnen"), F.array_join(F.collect_set("p_brand"), ", ").alias("konfiguration"))


@query(with_roles("SELECT * FROM chain", "components", "compatible", extra=CHAINS))
def config_paths(spark, sf_dir):
    return configure.chains(role(spark, sf_dir, "components"), role(spark, sf_dir, "compatible"))


@query(with_roles("SELECT c1, c2, c3, c4, win_prob FROM rated", "components", "compatible", extra=RATED))
def config_win_prob(spark, sf_dir):
    return configure.win_rates(config_paths(spark, sf_dir), past_offers(spark, sf_dir))


@query(with_roles(f"SELECT c1, c2, c3, c4, win_prob, preis, kosten, {ev('(preis - kosten) / preis * 100', 1)} AS marge_pct, {ev('(preis - kosten) / preis * 100 * win_prob', 2)} AS score FROM rated JOIN sums USING (c1, c2, c3, c4)", "components", "compatible", extra=CONFIG))
def config_scored(spark, sf_dir):
    return configure.scored(role(spark, sf_dir, "components"), past_offers(spark, sf_dir), role(spark, sf_dir, "compatible"))


# --- entity resolution ----------------------------------------------------------------------------

NAME = "lower(coalesce(firma_name, ''))"
for _form in resolve.company_name.__defaults__[0]:
    NAME = f"replace({NAME}, '{_form}', '')"
for _a, _b in (("ü", "ue"), ("ö", "oe"), ("ä", "ae"), ("ß", "ss"), ("-", " ")):
    NAME = f"replace({NAME}, '{_a}', '{_b}')"
NAME = f"regexp_replace(trim({NAME}), '\\s+', ' ', 'g')"
PREPARED = f"prep AS (SELECT firma_id, {NAME} AS name, coalesce(plz, '') AS plz, lower(coalesce(ort, '')) AS ort, coalesce(branche, '') AS branche, substring({NAME}, 1, 1) AS letter, substring(coalesce(plz, ''), 1, 2) AS area FROM companies)"
CANDIDATES = f"{PREPARED}, cand AS (SELECT a.firma_id AS a_id, b.firma_id AS b_id FROM prep a JOIN prep b ON a.area = b.area AND a.firma_id < b.firma_id WHERE a.area <> '' UNION SELECT a.firma_id, b.firma_id FROM prep a JOIN prep b ON a.letter = b.letter AND a.firma_id < b.firma_id WHERE a.letter <> '')"


def lev(a: str, b: str) -> str:
    return f"(CASE WHEN GREATEST(length({a}), length({b})) > 0 THEN {D(1)} - levenshtein({a}, {b}) / CAST(GREATEST(length({a}), length({b})) AS DOUBLE) ELSE {D(1)} END)"


SCORED_PAIRS = f"""{CANDIDATES}, sp AS (SELECT a_id, b_id, {lev('a.name', 'b.name')} AS ns, (CASE WHEN a.plz = b.plz THEN {D(1)} WHEN a.area = b.area THEN {D(0.5)} ELSE {D(0)} END) * {D(0.6)} + {lev('a.ort', 'b.ort')} * {D(0.4)} AS ads, CASE WHEN a.branche = b.branche THEN {D(1)} ELSE {D(0)} END AS bs
FROM cand JOIN prep a ON a.firma_id = a_id JOIN prep b ON b.firma_id = b_id)"""


TOTAL = f"ns * {D(0.6)} + ads * {D(0.3)} + bs * {D(0.1)}"


def candidate_rows(spark, sf_dir):
    # names are cleaned in all tasks, however few files there are
    return resolve.prepared(role(spark, sf_dir, "companies").repartition(2 * spark.sparkContext.defaultParallelism, "firma_id"))


@query(with_roles("SELECT a_id, b_id FROM cand", "companies", extra=CANDIDATES))
def resolve_blocked_pairs(spark, sf_dir):
    return resolve.candidates(candidate_rows(spark, sf_dir))


@query(with_roles(f"SELECT a_id, b_id, {ev('ns', 4)} AS name_score, {ev('ads', 4)} AS adress_score, bs AS branche_score, {ev(TOTAL, 4)} AS score, CASE WHEN {ev(TOTAL, 4)} >= 0.75 THEN 'rot' ELSE 'gelb' END AS ampel FROM sp WHERE {ev(TOTAL, 4)} >= 0.55", "companies", extra=SCORED_PAIRS))
def resolve_pairs_edit(spark, sf_dir):
    return resolve.duplicates(role(spark, sf_dir, "companies"), resolve.edit_ratio)


@query()
def resolve_pairs_ratio(spark, sf_dir):
    return resolve.reason(resolve.duplicates(role(spark, sf_dir, "companies")))


@query()
def resolve_search(spark, sf_dir):
    return resolve.search(role(spark, sf_dir, "companies"), "Maloda Basaki GmbH")


# --- series ---------------------------------------------------------------------------------------


def daily(spark, sf_dir):
    return role(spark, sf_dir, "series")


BY = "PARTITION BY p_type ORDER BY datum"


def roll(f: str, n: int, least: int) -> str:
    w = f"({BY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN COUNT(menge) OVER {w} >= {least} THEN {f}(menge) OVER {w} END"


@query(
    with_roles(
        f"SELECT p_type, datum, menge, {', '.join(f'LAG(menge, {k}) OVER ({BY}) AS lag_{k}' for k in series.LAGS)}, {ev(roll('AVG', 28, 7), 6)} AS roll_mean_28, {ev(f'COALESCE({roll("STDDEV_SAMP", 28, 7)}, 0)', 6)} AS roll_std_28, {ev(roll('AVG', 14, 3), 6)} AS roll_mean_14 FROM series",
        "series",
    )
)
def series_features(spark, sf_dir):
    out = series.features(daily(spark, sf_dir), ["p_type"])
    return out.withColumns({c: even(F.col(c), 6) for c in ("roll_mean_28", "roll_std_28", "roll_mean_14")})


@query(
    with_roles(
        f"SELECT s.p_type, s.datum, s.menge, {', '.join(f'COALESCE(v{k}.menge, m.mean) AS vor_{k}' for k in series.LAGS)} FROM series s JOIN (SELECT p_type, {dmean('menge')} AS mean FROM series GROUP BY p_type) m USING (p_type) "
        + " ".join(f"LEFT JOIN series v{k} ON v{k}.p_type = s.p_type AND v{k}.datum = s.datum - {k}" for k in series.LAGS),
        "series",
    )
)
def series_calendar_lags(spark, sf_dir):
    return series.calendar_lags(daily(spark, sf_dir), ["p_type"])


NAIVE = f"naive AS (SELECT s.p_type, s.datum, s.menge, COALESCE(a.menge, b.menge, {ev('s.l')}) AS naiv FROM (SELECT *, LAG(menge, 7) OVER ({BY}) AS l FROM series) s LEFT JOIN series a ON a.p_type = s.p_type AND a.datum = s.datum - 7 LEFT JOIN series b ON b.p_type = s.p_type AND b.datum = s.datum - 14)"


@query(
    with_roles(
        f"""SELECT p_type, COUNT(*) AS n, {ev(f"{dsum('ABS(menge - mittel)')} / {dsum('menge')}", 6)} AS wape, {ev(f"{dsum('ABS(menge - naiv)')} / {dsum('menge')}", 6)} AS wape_naiv, {ev(dmean('ABS(menge - mittel)'), 4)} AS mae, {ev(dmean('mittel - menge'), 4)} AS bias
        FROM (SELECT n.*, {ev(f'AVG(menge) OVER ({BY} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)')} AS mittel, MAX(datum) OVER (PARTITION BY p_type) AS last_day FROM naive n) WHERE datum > last_day - 28 AND mittel IS NOT NULL AND naiv IS NOT NULL GROUP BY p_type""",
        "series",
        extra=NAIVE,
    )
)
def series_backtest_naive(spark, sf_dir):
    rows = series.naive_baseline(series.features(daily(spark, sf_dir), ["p_type"]), ["p_type"]).withColumn("prognose", even(F.col("roll_mean_28")))
    out = series.backtest(rows, ["p_type"])
    return out.select("p_type", "n", even(F.col("wape"), 6).alias("wape"), even(F.col("wape_naiv"), 6).alias("wape_naiv"), even(F.col("mae"), 4).alias("mae"), even(F.col("bias"), 4).alias("bias"))


COMPLETE = "full_ AS (SELECT d.p_type, d.datum, s.menge FROM (SELECT p_type, CAST(unnest(generate_series(MIN(datum), MAX(datum), INTERVAL 1 DAY)) AS DATE) AS datum FROM series GROUP BY p_type) d LEFT JOIN series s USING (p_type, datum))"


@query(with_roles("SELECT p_type, datum, menge FROM full_", "series", extra=COMPLETE))
def series_gapfill(spark, sf_dir):
    return series.complete(daily(spark, sf_dir), ["p_type"])


@query(with_roles(f"SELECT p_type, datum, menge, COALESCE(LAST_VALUE(menge IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING), FIRST_VALUE(menge IGNORE NULLS) OVER ({BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS gefuellt FROM full_", "series", extra=COMPLETE))
def series_ffill_bfill(spark, sf_dir):
    return series.filled(series.complete(daily(spark, sf_dir), ["p_type"]), ["p_type"])


#: Holidays and school holidays of the sample years.
FIXED_DAYS = tuple(f"{y}-{d}" for y in range(1995, 2002) for d in ("01-01", "05-01", "10-03", "11-01", "12-25", "12-26"))
RANGES = tuple((f"{y}-07-01", f"{y}-08-12") for y in range(1995, 2002)) + tuple((f"{y}-12-22", f"{y + 1}-01-05") for y in range(1995, 2001))
CALENDAR = f"fixed AS (SELECT CAST(unnest([{', '.join(repr(d) for d in FIXED_DAYS)}]) AS DATE) AS d), span AS (SELECT CAST(a AS DATE) AS a, CAST(b AS DATE) AS b FROM (VALUES {', '.join(map(str, RANGES))}) t(a, b))"


@query(
    with_roles(
        "SELECT p_type, datum, CAST(isodow(datum) - 1 AS INT) AS wochentag, CAST(month(datum) AS INT) AS monat, CAST(week(datum) AS INT) AS kw, CAST(isodow(datum) >= 6 AS INT) AS wochenende, CAST(datum IN (SELECT d FROM fixed) AS INT) AS feiertag, CAST(EXISTS (SELECT 1 FROM span WHERE datum BETWEEN a AND b) AS INT) AS ferien FROM series",
        "series",
        extra=CALENDAR,
    )
)
def series_calendar(spark, sf_dir):
    days = spark.createDataFrame([(d,) for d in FIXED_DAYS], "d string").select(F.to_date("d").alias("date"))
    ranges = spark.createDataFrame(list(RANGES), "a string, b string").select(F.to_date("a").alias("start"), F.to_date("b").alias("end"))
    return series.holidays(series.calendar(daily(spark, sf_dir).drop("menge")), days, ranges)


@query(
    with_roles(
        f"""SELECT p_type, datum, prognose, naiv, GREATEST({D(0)}, {ev(f'prognose - GREATEST(sd, prognose * {D(0.1)}) * {D(1.5)}')}) AS unten, {ev(f'prognose + GREATEST(sd, prognose * {D(0.1)}) * {D(1.5)}')} AS oben, CASE WHEN naiv > 0 AND ABS(prognose - naiv) / naiv > {D(0.8)} THEN 'auffaellig' ELSE 'ok' END AS flag
        FROM (SELECT *, {ev(roll('AVG', 28, 7))} AS prognose, {ev(f'COALESCE({roll("STDDEV_SAMP", 28, 7)}, 0)', 6)} AS sd FROM naive) WHERE prognose IS NOT NULL AND naiv IS NOT NULL""",
        "series",
        extra=NAIVE,
    )
)
def series_flags(spark, sf_dir):
    rows = series.naive_baseline(series.features(daily(spark, sf_dir), ["p_type"]), ["p_type"]).withColumns({"prognose": even(F.col("roll_mean_28")), "roll_std_28": even(F.col("roll_std_28"), 6)})
    return series.flags(series.interval(rows.dropna(subset=["prognose", "naiv"]))).select("p_type", "datum", "prognose", "naiv", "unten", "oben", "flag")


@query()
def series_gbt_forecast(spark, sf_dir):
    rows = daily(spark, sf_dir)
    return series.forecast(rows, ["p_type"], series.trained(rows, ["p_type"]))


# --- graph and recommendation ---------------------------------------------------------------------

BEST_CUSTOMER = f"best AS (SELECT 'k:' || kunde_id AS s FROM purchases GROUP BY kunde_id ORDER BY SUM(CAST(umsatz AS DECIMAL(28,4))) DESC, kunde_id LIMIT 1)"
PPR = f"""one AS (SELECT 'k:' || kunde_id AS src, 'p:' || produkt_id AS dst, umsatz / SUM(umsatz) OVER (PARTITION BY kunde_id) AS w FROM (SELECT kunde_id, produkt_id, CAST(SUM(CAST(umsatz AS DECIMAL(28,4))) AS DOUBLE) AS umsatz FROM purchases GROUP BY ALL)),
ed AS (SELECT src, dst, w FROM one UNION ALL SELECT dst, src, w FROM one), mv AS MATERIALIZED (SELECT src, dst, w / SUM(w) OVER (PARTITION BY src) AS p FROM ed), {BEST_CUSTOMER},
walk(i, node, x) AS (SELECT 0, s, {D(1)} FROM best UNION ALL SELECT i + 1, node, SUM(x) FROM (SELECT i, mv.dst AS node, x * p * {D(graph.ALPHA)} AS x FROM walk JOIN mv ON mv.src = walk.node WHERE i < {graph.steps_for(1e-4)}
UNION ALL SELECT DISTINCT i, s, {D(1)} - {D(graph.ALPHA)} FROM walk, best WHERE i < {graph.steps_for(1e-4)}) GROUP BY i, node)"""


@query(with_roles(f"SELECT s AS start, node, {ev('x', 7)} AS score FROM walk, best WHERE i = {graph.steps_for(1e-4)}", "purchases", extra=PPR).replace("WITH ", "WITH RECURSIVE ", 1))
def recommend_ppr(spark, sf_dir):
    """Ranks of all products and customers for the customer of most revenue, as a report on one customer shows them."""
    rows = purchases(spark, sf_dir)
    best = rows.groupBy("kunde_id").agg(F.sum(F.col("umsatz").cast("decimal(28,4)")).alias("u")).orderBy(F.desc("u"), "kunde_id").limit(1)
    starts = best.select(F.concat(F.lit("k:"), F.col("kunde_id").cast("string")).alias("start"))
    return recommend.ranks_of_one(rows, starts, 1e-4).withColumn("score", even(F.col("score"), 7))


@query()
def recommend_hybrid(spark, sf_dir):
    return recommend.hybrid(purchases(spark, sf_dir), top=3)


@query(with_roles(f"SELECT kunde_id, COUNT(DISTINCT produkt_id) AS n_produkte, {ev('COUNT(DISTINCT produkt_id) / (SELECT CAST(COUNT(DISTINCT produkt_id) AS DOUBLE) FROM purchases) * 100')} AS abdeckung_pct FROM purchases WHERE umsatz > 0 GROUP BY kunde_id", "purchases"))
def recommend_coverage(spark, sf_dir):
    return recommend.coverage(purchases(spark, sf_dir))


@query(with_roles(f"SELECT produkt_id, preis, menge, {ev('preis * menge', -1)} AS jahreswert FROM (SELECT produkt_id, MEDIAN(einzelpreis) AS preis, COALESCE(MEDIAN(CASE WHEN jahr = (SELECT MAX(jahr) FROM purchases) THEN menge END), 1) AS menge FROM purchases GROUP BY produkt_id)", "purchases"))
def recommend_values(spark, sf_dir):
    return recommend.product_values(purchases(spark, sf_dir))


EVIDENCE = f"""{RECOMMEND}, o AS (SELECT DISTINCT kunde_id, produkt_id FROM purchases WHERE umsatz > 0), sz AS (SELECT kunde_id, COUNT(*) AS n FROM o GROUP BY kunde_id),
shared AS (SELECT r.kunde_id, r.produkt_id, b.kunde_id AS anderer, t.produkt_id AS teil FROM rec r JOIN o b ON b.produkt_id = r.produkt_id AND b.kunde_id <> r.kunde_id JOIN o t ON t.kunde_id = b.kunde_id JOIN o m ON m.kunde_id = r.kunde_id AND m.produkt_id = t.produkt_id),
beleg AS (SELECT s.kunde_id, s.produkt_id, s.anderer, s.n_gemeinsam, {ev('s.n_gemeinsam / CAST(x.n + y.n - s.n_gemeinsam AS DOUBLE)', 4)} AS jaccard, CAST(ROW_NUMBER() OVER (PARTITION BY s.kunde_id, s.produkt_id ORDER BY {ev('s.n_gemeinsam / CAST(x.n + y.n - s.n_gemeinsam AS DOUBLE)', 4)} DESC, s.n_gemeinsam DESC, s.anderer) AS INT) AS nr
FROM (SELECT kunde_id, produkt_id, anderer, COUNT(*) AS n_gemeinsam FROM shared GROUP BY ALL) s JOIN sz x ON x.kunde_id = s.kunde_id JOIN sz y ON y.kunde_id = s.anderer QUALIFY nr <= 3)"""


@query(with_roles("SELECT kunde_id, produkt_id, anderer, n_gemeinsam, jaccard, nr FROM beleg", "purchases", extra=EVIDENCE))
def recommend_evidence(spark, sf_dir):
    lists = basket.listed(purchases(spark, sf_dir))
    return recommend.evidence_listed(lists, basket.recommend_listed(lists), shared=False)


@query(
    with_roles(
        """SELECT r.kunde_id, r.produkt_id, n_kunden, belege, bruecke, CASE WHEN belege IS NULL THEN 'Das Modell leitet die Empfehlung aus latenten Kaufmustern ab.' ELSE n_kunden || ' vergleichbare Kunden setzen dieses Produkt bereits ein – darunter ' || belege || '. Die Verbindung läuft vor allem über Ihr Produkt „' || bruecke || '“.' END AS text
        FROM rec r JOIN (SELECT produkt_id, COUNT(*) AS n_kunden FROM o GROUP BY produkt_id) USING (produkt_id) LEFT JOIN (SELECT kunde_id, produkt_id, string_agg(anderer, ', ' ORDER BY nr) AS belege FROM beleg GROUP BY ALL) n ON n.kunde_id = r.kunde_id AND n.produkt_id = r.produkt_id
        LEFT JOIN (SELECT kunde_id, produkt_id, teil AS bruecke FROM (SELECT kunde_id, produkt_id, teil, COUNT(*) AS n, MIN(nr) AS erst FROM shared JOIN beleg USING (kunde_id, produkt_id, anderer) GROUP BY ALL) QUALIFY ROW_NUMBER() OVER (PARTITION BY kunde_id, produkt_id ORDER BY n DESC, erst, teil) = 1) b ON b.kunde_id = r.kunde_id AND b.produkt_id = r.produkt_id""",
        "purchases",
        extra=EVIDENCE,
    )
)
def recommend_explain(spark, sf_dir):
    lists = basket.listed(purchases(spark, sf_dir))
    return recommend.explain_listed(lists, basket.recommend_listed(lists))


@query(with_roles(f"SELECT COUNT(DISTINCT kunde_id) AS n_kunden, COUNT(DISTINCT produkt_id) AS n_produkte, CAST(SUM(kante) AS BIGINT) AS n_kanten, {ev('SUM(kante) / CAST(COUNT(DISTINCT kunde_id) * COUNT(DISTINCT produkt_id) AS DOUBLE) * 100', 1)} AS dichte FROM (SELECT kunde_id, produkt_id, MAX(CASE WHEN umsatz > 0 THEN 1 ELSE 0 END) AS kante FROM purchases GROUP BY ALL)", "purchases"))
def recommend_network(spark, sf_dir):
    return recommend.network(purchases(spark, sf_dir))


@query()
def communities(spark, sf_dir):
    own = owned(purchases(spark, sf_dir))
    return graph.communities(basket.pairs(own).where("lift > 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))


# --- anomalies and ensembles ----------------------------------------------------------------------

KNN = f"knn AS (SELECT v.vec_id, MIN(list_distance(CAST(v.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE label = 0) b GROUP BY v.vec_id)"


def distances(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return anomaly.nearest(vectors, vectors.where("label = 0"))


@query(f"WITH {KNN} SELECT vec_id, {ev('distance', 6)} AS distance FROM knn")
def knn_anomaly(spark, sf_dir):
    return distances(spark, sf_dir).withColumn("distance", even(F.col("distance"), 6))


@query(f"WITH {KNN}, t AS (SELECT quantile_cont(d, 0.95) AS schwelle, MAX(d) AS maximum FROM (SELECT {ev('distance', 6)} AS d FROM knn)) SELECT vec_id, {ev('distance', 6)} AS score, {ev(f'LEAST({ev("distance", 6)} / (maximum + {D("1e-8")}), {D(1)})', 6)} AS norm, CASE WHEN {ev('distance', 6)} > schwelle THEN 'NOK' ELSE 'OK' END AS decision FROM knn, t")
def anomaly_threshold(spark, sf_dir):
    scores = knn_anomaly(spark, sf_dir).withColumnRenamed("distance", "score")
    return anomaly.decided(scores, anomaly.threshold(scores)).withColumn("norm", even(F.col("norm"), 6))


@query(
    """WITH d AS (SELECT toxic AS y, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)), c AS (SELECT s, COUNT(CASE WHEN y = 1 THEN 1 END) AS p, COUNT(CASE WHEN y <> 1 THEN 1 END) AS n FROM d GROUP BY s),
    r AS (SELECT *, SUM(p) OVER (ORDER BY s DESC) AS tp, SUM(n) OVER (ORDER BY s DESC) AS fp FROM c), t AS (SELECT SUM(p) AS P, SUM(n) AS N, SUM(n * (tp - p) * 2 + n * p) AS area, SUM(CAST(CAST(p * tp AS DOUBLE) / (tp + fp) AS DECIMAL(38,10))) AS ap, SUM(CASE WHEN s > 2000 THEN p ELSE 0 END) AS TP_, SUM(CASE WHEN s > 2000 THEN n ELSE 0 END) AS FP_ FROM r)
    SELECT CAST(area AS DOUBLE) / (CAST(P AS DOUBLE) * N * 2) AS auc, CAST(ap AS DOUBLE) / CAST(P AS DOUBLE) AS ap, CAST(TP_ AS DOUBLE) / (TP_ + FP_) AS precision, CAST(TP_ AS DOUBLE) / P AS recall, 2 * CAST(TP_ AS DOUBLE) / (2 * TP_ + FP_ + (P - TP_)) AS f1 FROM t"""
)
def roc_metrics(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    return anomaly.metrics(rows, "toxic", "n_chars", 2000.0)


@query()
def coreset(spark, sf_dir):
    return anomaly.coreset(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query()
def reconstruction_anomaly(spark, sf_dir):
    return anomaly.reconstruction_scores(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


DAILY = f"sums AS (SELECT CAST(ts AS DATE) AS tag, sample_id, {dsum('value')} AS value FROM samples GROUP BY ALL), days AS (SELECT tag, {dmean('value')} AS mean, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.9) AS q90 FROM sums GROUP BY tag)"


@query(with_roles(f"SELECT tag, {ev('mean', 6)} AS mean, {ev('q10', 6)} AS q10, {ev('q90', 6)} AS q90 FROM days", "samples", extra=DAILY))
def ensemble_daily(spark, sf_dir):
    return ensemble.daily(role(spark, sf_dir, "samples")).withColumns({c: even(F.col(c), 6) for c in ("mean", "q10", "q90")})


@query(
    with_roles(
        f"SELECT {ev(dsum('mean'), 2)} AS summe, {ev(dsum('q10'), 2)} AS summe_q10, {ev(dsum('q90'), 2)} AS summe_q90, {ev(f'{dsum("q90")} * {D(1.1)}', 2)} AS sicher, {ev(dmean('(q90 - q10) / (mean + CAST(1e-8 AS DOUBLE)) * 100'), 2)} AS spanne_pct, arg_max(tag, mean) AS bester_tag, arg_min(tag, mean) AS schwaechster_tag, CAST(ceil({dsum('mean')} / 50) AS BIGINT) AS gebinde FROM days",
        "samples",
        extra=DAILY,
    )
)
def ensemble_plan(spark, sf_dir):
    out = ensemble.plan(ensemble.daily(role(spark, sf_dir, "samples")))
    return out.withColumns({c: even(F.col(c), 2) for c in ("summe", "summe_q10", "summe_q90", "sicher", "spanne_pct")})


@query(with_roles(f"SELECT sample_id, {ev(dmean('value'), 6)} AS mean, {ev('quantile_cont(value, 0.5)', 6)} AS median, {ev('quantile_cont(value, 0.1)', 6)} AS q10, {ev('quantile_cont(value, 0.9)', 6)} AS q90 FROM samples GROUP BY sample_id", "samples"))
def ensemble_statistics(spark, sf_dir):
    return ensemble.statistics(role(spark, sf_dir, "samples"), "sample_id").withColumns({c: even(F.col(c), 6) for c in ("mean", "median", "q10", "q90")})


@query()
def ensemble_bootstrap(spark, sf_dir):
    return ensemble.bootstrap(daily(spark, sf_dir), ["p_type"], 14)


# --- monitoring -----------------------------------------------------------------------------------

NEWEST = "newest AS (SELECT * FROM results ORDER BY created_at DESC, id LIMIT 500)"
LAST_TS = 1706659200.0  # 2024-01-31, after the last event


def results(spark, sf_dir):
    return role(spark, sf_dir, "results")


@query(
    with_roles(
        f"SELECT COUNT(*) AS total, COUNT(CASE WHEN decision = 'OK' THEN 1 END) AS ok, COUNT(CASE WHEN decision = 'NOK' THEN 1 END) AS nok, {ev('COUNT(CASE WHEN decision = ' + chr(39) + 'OK' + chr(39) + ' THEN 1 END) / CAST(COUNT(*) AS DOUBLE) * 100', 1)} AS ok_rate, {ev('COUNT(CASE WHEN decision = ' + chr(39) + 'NOK' + chr(39) + ' THEN 1 END) / CAST(COUNT(*) AS DOUBLE) * 100', 1)} AS nok_rate, {ev(dmean('anomaly_score', 8), 3)} AS avg_score, {ev(dmean('inference_ms', 6), 1)} AS avg_ms FROM newest",
        "results",
        extra=NEWEST,
    )
)
def monitor_stats(spark, sf_dir):
    return monitor.stats(monitor.latest(results(spark, sf_dir)))


@query(
    with_roles(
        f"SELECT CAST(d.tag AS INT) AS tag, COALESCE(total, 0) AS total, COALESCE(nok, 0) AS nok, COALESCE(total, 0) - COALESCE(nok, 0) AS ok FROM range(7) d(tag) LEFT JOIN (SELECT CAST(floor(({LAST_TS} - created_at) / 86400) AS INT) AS tag, COUNT(*) AS total, COUNT(CASE WHEN decision = 'NOK' THEN 1 END) AS nok FROM results WHERE created_at <= {LAST_TS} GROUP BY 1) c USING (tag)",
        "results",
    )
)
def monitor_daily_trend(spark, sf_dir):
    return monitor.daily_trend(results(spark, sf_dir), LAST_TS)


@query(with_roles("SELECT id, project_id, decision, anomaly_score FROM results ORDER BY created_at DESC, id LIMIT 500", "results"))
def monitor_latest(spark, sf_dir):
    return monitor.latest(results(spark, sf_dir)).select("id", "project_id", "decision", "anomaly_score")


@query(with_roles(f"SELECT project_id, COUNT(*) AS total, {ev('COUNT(CASE WHEN decision = ' + chr(39) + 'NOK' + chr(39) + ' THEN 1 END) / CAST(COUNT(*) AS DOUBLE) * 100', 1)} AS nok_rate FROM results GROUP BY project_id HAVING nok_rate > 20", "results"))
def monitor_alerts(spark, sf_dir):
    return monitor.alerts(results(spark, sf_dir))


@query("SELECT event_type, COUNT(*) AS n, SUM(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS summe FROM events GROUP BY event_type")
def events_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("summe"))


# The reports register their queries here as well.
from tallyloom.plans import reports  # noqa: E402, F401
