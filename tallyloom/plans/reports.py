"""More queries: what reports show of the engines (sentences, ranks, sizes), and the sources and sinks by round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.functions.exprs import day_text, even, first_word, unit_of
from tallyloom.operators import actions, anomaly, autoencoder, basket, churn, configure, deals, margin, monitor, quantile, resolve, series
from tallyloom.plans import catalog
from tallyloom.plans.catalog import ACTIONS, BY, CHURN, CONFIG, DEALS, EDGES, GROW, KNN, NAIVE, OWN, PRICED, SCORED_PAIRS, TOTAL, D, dsum, ev, g, query, roll, summary_sql, with_roles
from tallyloom.plans.roles import role
from tallyloom.sources import tables
from tallyloom.sources.session import shared_dir

# --- texts ----------------------------------------------------------------------------------------


def n0(x: str) -> str:
    return f"format('{{:.0f}}', CAST({x} AS DOUBLE))"


def n1(x: str) -> str:
    return f"format('{{:.1f}}', {ev(f'CAST({x} AS DOUBLE)', 1)})"


def plus(x: str) -> str:
    return f"format('{{:+.0f}}', CAST({x} AS DOUBLE))"


def comma(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


def pct(name: str) -> str:
    return plus(g(f"{name}_ytd", f"{name}_vorjahr"))


GROUP = "CASE WHEN lower(trim(wettbewerber_produktgruppe)) IN ('nan', 'none', '-', '—') THEN '' ELSE trim(wettbewerber_produktgruppe) END"
LOST = "GREATEST(0, produkte_vorjahr - produkte_aktuell)"
CHURN_TEXTS = {
    "umsatz": (f"{pct('umsatz')} || ' %'", f"CASE WHEN {g('umsatz_ytd', 'umsatz_vorjahr')} < 0 THEN 'Umsatz ' || {pct('umsatz')} || ' % gegenüber Vorjahr (' || {comma('umsatz_vorjahr - umsatz_ytd')} || ' € Rückgang).' ELSE 'Umsatz ' || {pct('umsatz')} || ' % gegenüber Vorjahr – stabil bis wachsend.' END"),
    "bestellfreq": (f"{pct('bestellungen')} || ' %'", f"{n0('bestellungen_ytd')} || ' Bestellungen im laufenden Jahr gegenüber ' || {n0('bestellungen_vorjahr')} || ' im Vorjahr.'"),
    "letzter_kauf": (f"{n0('tage_seit_letztem_einkauf')} || ' Tage'", f"'Letzter Auftragseingang vor ' || {n0('tage_seit_letztem_einkauf')} || ' Tagen.'"),
    "wettbewerb": (
        f"CASE WHEN {GROUP} <> '' THEN {GROUP} WHEN wettbewerber_aktiv = 1 THEN 'aktiv' ELSE '—' END",
        f"CASE WHEN wettbewerber_aktiv = 1 AND {GROUP} <> '' THEN 'Wettbewerber gewinnt Anteile in der Produktgruppe „' || {GROUP} || '“.' WHEN wettbewerber_aktiv = 1 THEN 'Wettbewerber im Account aktiv.' ELSE 'Kein Wettbewerbsdruck erkennbar.' END",
    ),
    "portfolio": (f"{n0('produkte_aktuell')} || ' von ' || {n0('produkte_vorjahr')}", f"CASE WHEN {LOST} > 0 THEN {n0(LOST)} || ' Produktgruppe(n) gegenüber Vorjahr abbestellt.' ELSE 'Portfolio unverändert oder ausgebaut.' END"),
    "service": (f"{n0('service_faelle')} || ' / ' || {n0('reklamationen')}", f"{n0('service_faelle')} || ' Servicefälle (Vorjahr ' || {n0('service_faelle_vorjahr')} || '), ' || {n0('reklamationen')} || ' Reklamationen (Vorjahr ' || {n0('reklamationen_vorjahr')} || ').'"),
    "ansprechpartner": (n0("ansprechpartner_wechsel"), f"CASE WHEN ansprechpartner_wechsel > 0 THEN {n0('ansprechpartner_wechsel')} || ' Wechsel auf Kundenseite – gewachsene Beziehungen gehen verloren.' ELSE 'Ansprechpartner stabil.' END"),
    "zahlung": (f"{n0('zahlungsverzug_tage')} || ' Tage'", f"CASE WHEN zahlungsverzug_tage > 0 OR mahnungen > 0 THEN 'Ø ' || {n0('zahlungsverzug_tage')} || ' Tage Zahlungsverzug, ' || {n0('mahnungen')} || ' Mahnung(en).' ELSE 'Zahlungsverhalten unauffällig.' END"),
    "angebote": (f"{pct('angebote')} || ' %'", f"{n0('angebote_ytd')} || ' Anfragen im laufenden Jahr gegenüber ' || {n0('angebote_vorjahr')} || ' im Vorjahr.'"),
    "preis": (f"'+' || {n1('preisanpassung_pct')} || ' %'", f"CASE WHEN preisanpassung_pct > 3 THEN 'Preise um ' || {n1('preisanpassung_pct')} || ' % angehoben – bei aktivem Wettbewerb ein Abwanderungsanlass.' ELSE 'Preisanpassung von ' || {n1('preisanpassung_pct')} || ' % im üblichen Rahmen.' END"),
    "kommunikation": (f"{pct('kontakte')} || ' %'", f"{n0('kontakte_ytd')} || ' Kundenkontakte gegenüber ' || {n0('kontakte_vorjahr')} || ' im Vorjahr.'"),
}


@query(with_roles(" UNION ALL ".join(f"SELECT kunde_id, '{k}' AS key, {wert} AS wert, {text} AS text FROM accounts" for k, (wert, text) in CHURN_TEXTS.items()), "accounts"))
def churn_texts(spark, sf_dir):
    return churn.sentences(role(spark, sf_dir, "accounts"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NAMED = f"CASE WHEN {GROUP} <> '' THEN {GROUP} ELSE {quoted(churn.NO_GROUP)} END"
MEASURES = "todo AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {quoted(action)}, {quoted(churn.DETAILS[k])})" for k, _, _, action in churn.SIGNALS) + ") t(dominant, a, d))"


@query(with_roles(f"SELECT kunde_id, replace(a, '{{gruppe}}', {NAMED}) AS aktion, replace(d, '{{gruppe}}', {NAMED}) AS detail, frist FROM scores JOIN todo USING (dominant) JOIN (SELECT kunde_id, wettbewerber_produktgruppe FROM accounts) USING (kunde_id)", "accounts", extra=f"{CHURN}, {MEASURES}"))
def churn_measures(spark, sf_dir):
    return catalog.churned(spark, sf_dir).select("kunde_id", "aktion", "detail", "frist")


@query(with_roles("SELECT kunde_id, umsatz_risiko, risiko, CAST(ROW_NUMBER() OVER (ORDER BY umsatz_risiko DESC, kunde_id) AS INT) AS rang FROM scores ORDER BY rang LIMIT 25", "accounts", extra=CHURN))
def churn_top(spark, sf_dir):
    return churn.by_risk(catalog.churned(spark, sf_dir), 25).select("kunde_id", "umsatz_risiko", "risiko", "rang")


DEAL_COUNT = f"{n0('offene_opps')} || ' offene Opportunity(s) über ' || {comma('opp_wert')} || ' €'"
ACTION_TEXTS = {
    "churn": f"'Umsatz ' || {plus(GROW)} || ' % gegenüber Vorjahr (' || {comma('umsatz_vorjahr - umsatz_ytd')} || ' € Rückgang).'",
    "wettbewerb": f"CASE WHEN {GROW} < 0 THEN 'Wettbewerber aktiv im Account bei gleichzeitig sinkendem Bestellvolumen.' ELSE 'Wettbewerber ist im Account aktiv – Position verteidigen.' END",
    "deal_risk": f"CASE WHEN letzter_kontakt_tage > 25 THEN {DEAL_COUNT} || ', aber seit ' || {n0('letzter_kontakt_tage')} || ' Tagen kein Kontakt.' ELSE {DEAL_COUNT} || ' in aktiver Bearbeitung.' END",
    "trigger": "trigger_event || ' – konkreter Anlass für ein Erweiterungsgespräch.'",
    "cross_sell": f"'Portfolio-Abdeckung nur ' || {n0('portfolio_abdeckung_pct')} || ' % – Produktlücken im Wert von ' || {comma('produktluecken_wert')} || ' €.'",
    "service": f"'Service-Tickets von ' || {n0('service_tickets_vorquartal')} || ' auf ' || {n0('service_tickets')} || ' gestiegen (+' || {n0(f'({D("service_tickets")} / service_tickets_vorquartal - 1) * 100')} || ' %) – Zufriedenheitsrisiko.'",
    "beziehung": f"'Nur ' || {n0('kontakte_aktiv')} || ' von ' || {n0('kontakte_gesamt')} || ' Kontakten aktiv – ' || {n0('kontakte_gesamt - kontakte_aktiv')} || ' Ansprechpartner nicht mehr erreichbar.'",
}


@query(with_roles(" UNION ALL ".join(f"SELECT kunde_id, '{k}' AS signal, {text} AS text FROM accounts WHERE {catalog.FOUND[k][0]}" for k, text in ACTION_TEXTS.items()), "accounts"))
def actions_texts(spark, sf_dir):
    return actions.sentences(role(spark, sf_dir, "accounts"))


TODO = "todo AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {quoted(action)}, {quoted(actions.DETAILS[k])})" for k, _, _, _, action in actions.SIGNALS) + ") t(dominant, aktion, d))"


@query(
    with_roles(
        f"SELECT kunde_id, aktion, replace(replace(d, '{{anlass}}', CASE WHEN trigger_event <> '—' THEN trigger_event ELSE {quoted(actions.NO_TRIGGER)} END), '{{luecken}}', {comma('produktluecken_wert')}) AS detail, CASE dringlichkeit WHEN 3 THEN 'innerhalb 48 h' WHEN 2 THEN 'diese Woche' ELSE 'in 2 Wochen' END AS frist FROM ranked JOIN todo USING (dominant) JOIN (SELECT kunde_id, trigger_event, produktluecken_wert FROM accounts) USING (kunde_id)",
        "accounts",
        extra=f"{ACTIONS}, {TODO}",
    )
)
def actions_measures(spark, sf_dir):
    return catalog.acted(spark, sf_dir).select("kunde_id", "aktion", "detail", "frist")


@query(with_roles(f"SELECT COUNT(*) AS aktionen, COUNT(CASE WHEN dringlichkeit = 3 THEN 1 END) AS dringend, {dsum('wert', 6)} AS wert, {ev('AVG(score)', 1)} AS avg_score FROM ranked", "accounts", extra=ACTIONS))
def actions_kpis(spark, sf_dir):
    return actions.kpis(catalog.acted(spark, sf_dir))


ROLES_OF = "nr AS (SELECT opp_id, string_agg(rolle, ', ' ORDER BY rolle) FILTER (wettbewerber_kontakt = 1) AS rr, string_agg(rolle, ', ' ORDER BY rolle) FILTER (sentiment = 'negativ') AS ng FROM contacts WHERE involviert = 1 GROUP BY opp_id)"
DEAL_TEXTS = f"""SELECT f.opp_id, titel, CASE pos WHEN 0 THEN 'Bei ' || {comma('deal_wert')} || ' € Deal-Wert ist keine CFO-/Einkaufsleitung im Buying Center aktiv. Historisch scheitern Deals dieser Größe ohne Finanzfreigabe deutlich häufiger.'
WHEN 1 THEN 'CFO / Einkaufsleitung ist aktiv im Entscheidungsprozess.' WHEN 2 THEN 'Deals über 250.000 € werden in der Regel auf Geschäftsführungsebene entschieden.' WHEN 3 THEN 'Kein technischer Ansprechpartner involviert – die Lösungsvalidierung fehlt.'
WHEN 4 THEN 'Direkter Wettbewerberkontakt über: ' || rr || '. Wettbewerber: ' || wettbewerber || '.' WHEN 5 THEN wettbewerber || ' bietet ebenfalls an, hat aber keinen erkennbaren Draht ins Buying Center.'
WHEN 6 THEN {n0('tage_in_stage')} || ' Tage in Stage „' || stage || '“ – Median liegt bei ' || {n0('x.med')} || ' Tagen.' WHEN 7 THEN 'Letzter Kontakt vor ' || {n0('letzter_kontakt_tage')} || ' Tagen. Ab 30 Tagen sinkt die Abschlussquote messbar.'
WHEN 8 THEN 'Letzter Kontakt vor ' || {n0('letzter_kontakt_tage')} || ' Tagen – der Deal ist aktiv in Bewegung.' WHEN 9 THEN {n0('rabatt_gefordert_pct')} || ' % Nachlass gefordert – Indiz für reinen Preiswettbewerb statt Wertargumentation.'
WHEN 10 THEN 'Negatives Sentiment bei: ' || ng || '.' ELSE 'Win-Rate in dieser Branche: ' || {n0('COALESCE(brate, rate) * 100')} || ' % (Gesamt: ' || {n0('rate * 100')} || ' %).' END AS text
FROM f JOIN x USING (opp_id) LEFT JOIN nr USING (opp_id) LEFT JOIN branch USING (branche), ref"""


@query(with_roles(DEAL_TEXTS, "deals", "contacts", extra=f"{DEALS}, {ROLES_OF}"))
def deals_texts(spark, sf_dir):
    return deals.sentences(role(spark, sf_dir, "deals"), role(spark, sf_dir, "contacts"))


DEAL_TODO = "todo AS (SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(quoted, row))})" for row in deals.ACTIONS) + ") t(top_risiko, a, d, f))"


@query(
    with_roles(
        f"SELECT opp_id, CASE WHEN top_risiko IS NULL THEN {quoted(deals.NO_RISK[0])} ELSE COALESCE(a, {quoted(deals.OTHER_RISK[0])}) END AS aktion, CASE WHEN top_risiko IS NULL THEN {quoted(deals.NO_RISK[1])} ELSE COALESCE(d, {quoted(deals.OTHER_RISK[1])}) END AS detail, CASE WHEN top_risiko IS NULL THEN {quoted(deals.NO_RISK[2])} ELSE COALESCE(todo.f, {quoted(deals.OTHER_RISK[2])}) END AS frist FROM scored LEFT JOIN todo USING (top_risiko)",
        "deals",
        "contacts",
        extra=f"{DEALS}, {DEAL_TODO}",
    )
)
def deals_measures(spark, sf_dir):
    return catalog.dealt(spark, sf_dir).select("opp_id", "aktion", "detail", "frist")


@query(with_roles("SELECT (SELECT COUNT(DISTINCT n) FROM (SELECT src AS n FROM e UNION ALL SELECT dst FROM e)) AS n_knoten, COUNT(*) AS n_kanten FROM e", "deals", "contacts", extra=EDGES))
def deals_network(spark, sf_dir):
    return deals.network(catalog.deals_graph_edges(spark, sf_dir))


# --- ranks ----------------------------------------------------------------------------------------


@query(with_roles("SELECT vertriebsmitarbeiter, avg_rabatt, n, umsatz, CAST(ROW_NUMBER() OVER (ORDER BY avg_rabatt DESC, vertriebsmitarbeiter) AS INT) AS rang FROM g ORDER BY rang LIMIT 10", "offers", extra=f"{PRICED}, g AS ({summary_sql('vertriebsmitarbeiter')})"))
def margin_rep_ranks(spark, sf_dir):
    return margin.ordered(margin.summary(catalog.offers(spark, sf_dir), "vertriebsmitarbeiter"), "vertriebsmitarbeiter", 10).select("vertriebsmitarbeiter", "avg_rabatt", "n", "umsatz", "rang")


@query(with_roles("SELECT kunde, umsatz, CAST(ROW_NUMBER() OVER (ORDER BY umsatz DESC, kunde) AS INT) AS rang FROM g ORDER BY rang LIMIT 20", "offers", extra=f"{PRICED}, g AS ({summary_sql('kunde')})"))
def margin_customer_ranks(spark, sf_dir):
    return margin.ordered(margin.summary(catalog.offers(spark, sf_dir), "kunde"), "kunde", 20, "umsatz").select("kunde", "umsatz", "rang")


PAIR_ROWS = f"{SCORED_PAIRS}, rated_ AS (SELECT a_id, b_id, {ev(TOTAL, 4)} AS score FROM sp WHERE {ev(TOTAL, 4)} >= 0.55)"


@query(with_roles("SELECT a_id, b_id, score FROM rated_ ORDER BY score DESC, a_id, b_id LIMIT 40", "companies", extra=PAIR_ROWS))
def resolve_top40(spark, sf_dir):
    return resolve.top(catalog.resolve_pairs_edit(spark, sf_dir)).select("a_id", "b_id", "score")


@query(with_roles("SELECT COUNT(CASE WHEN score >= 0.75 THEN 1 END) AS rot, COUNT(CASE WHEN score < 0.75 THEN 1 END) AS gelb FROM rated_", "companies", extra=PAIR_ROWS))
def resolve_lights(spark, sf_dir):
    return resolve.lights(catalog.resolve_pairs_edit(spark, sf_dir))


@query(
    with_roles(
        f"SELECT c1, c2, c3, c4, split_part(c2, ' ', 1) || ' + ' || split_part(c3, ' ', 1) || ' + ' || split_part(c4, ' ', 1) AS label, {ev('(preis - kosten) / preis * 100 * win_prob', 2)} AS score FROM rated JOIN sums USING (c1, c2, c3, c4) ORDER BY score DESC, c1, c2, c3, c4 LIMIT 5",
        "components",
        "compatible",
        extra=CONFIG,
    )
)
def config_top5(spark, sf_dir):
    best = configure.top(catalog.config_scored(spark, sf_dir))
    # a component's name is its id in the sample
    return best.select("c1", "c2", "c3", "c4", F.concat_ws(" + ", *[first_word(F.col(c)) for c in ("c2", "c3", "c4")]).alias("label"), "score")


@query(with_roles("SELECT a, b FROM (SELECT a, b FROM given UNION SELECT b, a FROM given) WHERE b IN (SELECT komponente_id FROM components) AND a IN (SELECT komponente_id FROM components)", "components", "compatible", extra="given AS (SELECT a, b FROM compatible WHERE a < b)"))
def config_edges(spark, sf_dir):
    lists = role(spark, sf_dir, "compatible").where("a < b").groupBy(F.col("a").alias("komponente_id")).agg(F.array_join(F.collect_set("b"), ", ").alias("kompatibel_mit"))
    return configure.edges(role(spark, sf_dir, "components").join(lists, "komponente_id", "left"))


@query(with_roles(f"SELECT produkt_id, COUNT(DISTINCT kunde_id) AS n_kunden, {dsum('umsatz')} AS umsatz FROM own GROUP BY produkt_id", "purchases", extra=OWN))
def basket_nodes(spark, sf_dir):
    own = catalog.owned(catalog.purchases(spark, sf_dir))
    return own.groupBy("produkt_id").agg(F.count_distinct("kunde_id").alias("n_kunden"), F.sum(F.col("umsatz").cast("decimal(28,4)")).cast("double").alias("umsatz"))


# --- series ---------------------------------------------------------------------------------------

LAST = "recent AS (SELECT p_type, datum, CAST(menge AS DOUBLE) AS v FROM series QUALIFY ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY datum DESC) <= 528), stat AS (SELECT p_type, AVG(v) AS m, STDDEV_POP(v) + CAST(1e-8 AS DOUBLE) AS s FROM recent GROUP BY p_type)"


@query(with_roles(f"SELECT p_type, datum, {ev('(v - m) / s', 6)} AS z FROM recent JOIN stat USING (p_type)", "series", extra=LAST))
def series_normalised(spark, sf_dir):
    return series.normalised(catalog.daily(spark, sf_dir), ["p_type"]).select("p_type", "datum", even(F.col("z"), 6).alias("z"))


@query(with_roles(f"SELECT p_type, datum, {ev('GREATEST(CAST(0 AS DOUBLE), (v - m) / s * s + m)', 6)} AS wert FROM recent JOIN stat USING (p_type)", "series", extra=LAST))
def series_denormalised(spark, sf_dir):
    return series.denormalised(series.normalised(catalog.daily(spark, sf_dir), ["p_type"])).select("p_type", "datum", even(F.col("wert"), 6).alias("wert"))


@query(with_roles("SELECT p_type, COUNT(*) AS n, COUNT(*) < 528 AS zu_kurz, CASE WHEN COUNT(*) < 528 THEN 'Zu wenig Daten: ' || COUNT(*) || ' Zeilen, mindestens 528 benötigt.' END AS meldung FROM series GROUP BY p_type", "series"))
def series_long_enough(spark, sf_dir):
    return series.long_enough(catalog.daily(spark, sf_dir), ["p_type"])


FLAGS = f"flags AS (SELECT p_type, datum, prognose, CASE WHEN naiv > 0 AND ABS(prognose - naiv) / naiv > {D(0.8)} THEN 1 ELSE 0 END AS f FROM (SELECT *, {ev(roll('AVG', 28, 7))} AS prognose FROM naive) WHERE prognose IS NOT NULL AND naiv IS NOT NULL)"


@query(with_roles(f"SELECT p_type, {dsum('prognose')} AS summe, CAST(SUM(f) AS BIGINT) AS n_auffaellig, CAST(MAX(f) AS INT) AS auffaellig FROM flags GROUP BY p_type", "series", extra=f"{NAIVE}, {FLAGS}"))
def series_overview(spark, sf_dir):
    return series.overview(catalog.series_flags(spark, sf_dir), ["p_type"])


@query(with_roles(f"SELECT p_type, datum, CASE WHEN day(datum) = 1 THEN prognose + 10 ELSE prognose END AS final FROM (SELECT *, {ev(roll('AVG', 28, 7))} AS prognose FROM series) WHERE prognose IS NOT NULL", "series"))
def series_corrected(spark, sf_dir):
    rows = series.features(catalog.daily(spark, sf_dir), ["p_type"]).withColumn("prognose", even(F.col("roll_mean_28"))).where("prognose IS NOT NULL").select("p_type", "datum", "prognose")
    fixes = rows.where(F.dayofmonth("datum") <= 2).select("p_type", "datum", F.when(F.dayofmonth("datum") == 1, F.col("prognose") + 10).alias("wert"))
    return series.corrected(rows, fixes, ["p_type"]).select("p_type", "datum", "final")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS datum, strftime(o_orderdate, '%d.%m.%Y') AS lang, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d.%m.') AS kurz, CASE isodow(o_orderdate) WHEN 1 THEN 'Mo' WHEN 2 THEN 'Di' WHEN 3 THEN 'Mi' WHEN 4 THEN 'Do' WHEN 5 THEN 'Fr' WHEN 6 THEN 'Sa' ELSE 'So' END || ' ' || strftime(o_orderdate, '%d.%m.') AS woche FROM orders")
def day_texts(spark, sf_dir):
    day = F.to_date("o_orderdate")
    forms = {"lang": "long", "iso": "iso", "kurz": "short", "woche": "week"}
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(day.alias("datum"), *[day_text(day, f).alias(c) for c, f in forms.items()]).distinct()


@query("SELECT c_name, contains(lower(c_name), 'beer') OR contains(lower(c_name), 'bier') AS bier, starts_with(c_mktsegment, 'B') AS mit_b FROM customer")
def name_hints(spark, sf_dir):
    """What a name contains or starts with, as units and report texts are chosen by."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_name", (unit_of(F.col("c_name")) == "Liter").alias("bier"), F.col("c_mktsegment").startswith("B").alias("mit_b"))


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS datum FROM orders), live AS (SELECT CAST(o_orderdate AS DATE) AS datum, CAST(COUNT(*) AS DOUBLE) AS t FROM orders WHERE day(o_orderdate) = 1 GROUP BY ALL) " + f"SELECT datum, {ev('COALESCE(t, CAST(16.5 AS DOUBLE) + CAST(12.5 AS DOUBLE) * sin((dayofyear(datum) - 80) / CAST(365 AS DOUBLE) * 2 * pi()))', 6)} AS temperatur FROM d LEFT JOIN live USING (datum)")
def series_temperature(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("datum"))
    live = orders.where(F.dayofmonth("datum") == 1).groupBy(F.col("datum").alias("date")).agg(F.count("*").cast("double").alias("temperatur"))
    return series.temperature(orders.distinct(), live).withColumn("temperatur", even(F.col("temperatur"), 6))


# --- anomalies and monitoring ---------------------------------------------------------------------


@query(f"WITH {KNN} SELECT CAST(vec_id // 10 AS BIGINT) AS bild, MAX({ev('distance', 6)}) AS score FROM knn GROUP BY 1")
def image_scores(spark, sf_dir):
    """Ten vectors in a row stand for an image's patches."""
    return anomaly.image_scores(catalog.knn_anomaly(spark, sf_dir).withColumn("bild", F.floor(F.col("vec_id") / 10)), "bild")


@query(with_roles("SELECT id, project_id, decision, strftime(make_timestamp(CAST(created_at * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS created_at FROM newest", "results", extra=catalog.NEWEST))
def monitor_report(spark, sf_dir):
    return monitor.report(catalog.results(spark, sf_dir)).select("id", "project_id", "decision", "created_at")


@query(
    with_roles(
        f"SELECT id, project_id, CAST(total AS BIGINT) AS total, nok_rate, nok_rate > 20 AS alarm FROM (SELECT id, project_id, COUNT(*) OVER w AS total, {ev('COUNT(CASE WHEN decision = ' + chr(39) + 'NOK' + chr(39) + ' THEN 1 END) OVER w / CAST(COUNT(*) OVER w AS DOUBLE) * 100', 1)} AS nok_rate FROM results WINDOW w AS (PARTITION BY project_id, CAST(floor(created_at / 86400) AS BIGINT) ORDER BY created_at, id ROWS UNBOUNDED PRECEDING))",
        "results",
    )
)
def monitor_running_rate(spark, sf_dir):
    return monitor.running_rate(catalog.results(spark, sf_dir))


SHARES = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


@query(with_roles("SELECT produkt_id, " + ", ".join(f"{ev(f'quantile_cont(einzelpreis, {v})', 4)} AS {k}" for k, v in SHARES.items()) + " FROM purchases GROUP BY produkt_id", "purchases"))
def price_quantiles(spark, sf_dir):
    """Five quantiles of each product's price, from histograms of bounded size."""
    found = quantile.quantiles(catalog.purchases(spark, sf_dir), ["produkt_id"], "einzelpreis", SHARES)
    return found.select("produkt_id", *[even(F.col(k), 4).alias(k) for k in SHARES])


@query(with_roles("SELECT " + ", ".join(f"{ev(f'quantile_cont(umsatz, {v})', 4)} AS {k}" for k, v in SHARES.items()) + " FROM purchases", "purchases"))
def revenue_quantiles(spark, sf_dir):
    """The same of all revenue: one group of all rows, which no task gathers."""
    return quantile.quantiles(catalog.purchases(spark, sf_dir), [], "umsatz", SHARES).select(*[even(F.col(k), 4).alias(k) for k in SHARES])


@query()
def reconstruction_curved(spark, sf_dir):
    """Errors after the bottleneck of an autoencoder, beside those of principal components in reconstruction_anomaly."""
    return autoencoder.scores(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# --- slices that a page shows of a result ---------------------------------------------------------


@query(with_roles("SELECT a, b, lift FROM pairs ORDER BY lift DESC, n DESC, a, b LIMIT 10", "purchases", extra=catalog.PAIRS))
def basket_first10(spark, sf_dir):
    own = catalog.owned(catalog.purchases(spark, sf_dir))
    return basket.top_pairs(basket.pairs(own), 10).select("a", "b", "lift")


@query(with_roles("SELECT kunde_id, risiko, umsatz_risiko FROM scores WHERE risiko >= 25", "accounts", extra=CHURN))
def churn_list25(spark, sf_dir):
    return catalog.churned(spark, sf_dir).where("risiko >= 25").select("kunde_id", "risiko", "umsatz_risiko")


@query(with_roles("SELECT c1, c2, c3, c4, win_prob FROM rated ORDER BY win_prob DESC, c1, c2, c3, c4 LIMIT 1", "components", "compatible", extra=catalog.RATED))
def config_best_win(spark, sf_dir):
    rates = catalog.config_win_prob(spark, sf_dir)
    return rates.orderBy(F.desc("win_prob"), "c1", "c2", "c3", "c4").limit(1)


@query(with_roles(f"SELECT kunde_id, MIN(kunde_name) AS kunde_name, MIN(branche) AS branche, string_agg(DISTINCT produkt_id, ', ' ORDER BY produkt_id) AS produkte, COUNT(DISTINCT produkt_id) AS n_produkte, {dsum('umsatz')} AS umsatz FROM purchases JOIN (SELECT c_custkey AS kunde_id, c_name AS kunde_name, c_mktsegment AS branche FROM customer) c USING (kunde_id) GROUP BY kunde_id", "purchases"))
def customer_cards(spark, sf_dir):
    """Customers with their names and branch beside the ids."""
    named = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("kunde_id"), F.col("c_name").alias("kunde_name"), F.col("c_mktsegment").alias("branche"))
    return basket.customers(catalog.purchases(spark, sf_dir).join(named, "kunde_id"), ("kunde_name", "branche"))


# --- sources and sinks ----------------------------------------------------------------------------


def scratch(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    """Written as CSV with a header, read back with the separator found and types inferred."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = scratch(spark, "customers") + ".csv"
    tables.write_csv(rows, path)
    back = tables.read(spark, path)
    return back.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def workbook_round_trip(spark, sf_dir):
    """Written as workbooks in tasks, read back from all of them with types found."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = scratch(spark, "customers") + ".xlsx"
    tables.write_excel(rows, path)
    return tables.read(spark, path).select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS datum FROM orders")
def csv_dates(spark, sf_dir):
    """Days written as text and read back as days."""
    path = scratch(spark, "orders") + ".csv"
    tables.write_csv(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("datum")), path)
    back = tables.read(spark, path, dates=("datum",))
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "datum")


@query("SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def json_round_trip(spark, sf_dir):
    """As JSON rows and back by the schema."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    return tables.as_json(rows).select(F.from_json("json", rows.schema).alias("r")).select("r.*")


@query("SELECT CAST(MAX(o_orderdate) AS DATE) AS datum FROM orders")
def freshness(spark, sf_dir):
    return tables.freshness(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("datum")))


@query("SELECT c_custkey AS kunde_id, upper(substring(c_name, 1, 4)) AS produkt_id, 'Unbekannt' AS kategorie, CAST(1 AS DOUBLE) AS umsatz FROM customer")
def purchases_from_names(spark, sf_dir):
    """A table under other names, without keys, revenue and category."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("kunde_id"), F.col("c_name").alias("produkt_name"))
    return tables.purchases(rows).select("kunde_id", "produkt_id", "kategorie", "umsatz")
