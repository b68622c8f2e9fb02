"""The driver's tables in the roles that the engines expect.

Each role is one SELECT that Spark and DuckDB both run, so a query and its SQL twin start from the same rows.
DATEDIFF(a, b) stands for the days from a to b.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")

#: Revenue of a line in ten-thousandths, exactly.
REV = "CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))"
NOW, CURRENT, PREVIOUS = "DATE '2000-12-31'", 2000, 1999

ROLES = {
    "offers": f"""
SELECT l_orderkey AS angebot_id, l_partkey, l_suppkey, l_linenumber, p_name AS produkt, c_name AS kunde, n_name AS vertriebsmitarbeiter,
  c_mktsegment AS segment, l_quantity AS menge, p_retailprice AS listenpreis,
  CAST({REV} AS DOUBLE) / 10000 / l_quantity AS verkaufspreis, CAST({REV} AS DOUBLE) / 10000 AS umsatz, round(l_discount * 100) AS rabatt_pct
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{part}} ON l_partkey = p_partkey""",
    "purchases": f"""
SELECT o_custkey AS kunde_id, p_name AS produkt_id, p_type AS kategorie, year(o_orderdate) AS jahr, l_quantity AS menge,
  l_extendedprice / l_quantity AS einzelpreis, CAST({REV} AS DOUBLE) / 10000 AS umsatz
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey""",
    "accounts": f"""
SELECT c_custkey AS kunde_id, c_name AS kunde_name, n_name AS vertriebsmitarbeiter, c_mktsegment AS branche,
  CAST(coalesce(a.rev, 0) AS DOUBLE) / 10000 AS umsatz_ytd, CAST(coalesce(a.rev_v, 0) AS DOUBLE) / 10000 AS umsatz_vorjahr,
  coalesce(a.orders, 0) AS bestellungen_ytd, coalesce(a.orders_v, 0) AS bestellungen_vorjahr, coalesce(k.kinds, 0) AS produkte_aktuell, coalesce(k.kinds_v, 0) AS produkte_vorjahr,
  coalesce(DATEDIFF(a.last_day, {NOW}), 365) AS tage_seit_letztem_einkauf, coalesce(a.returned, 0) AS service_faelle, coalesce(a.returned_v, 0) AS service_faelle_vorjahr,
  coalesce(a.taken, 0) AS reklamationen, coalesce(a.taken_v, 0) AS reklamationen_vorjahr, coalesce(a.urgent, 0) AS ansprechpartner_wechsel, coalesce(a.partial, 0) * 10 AS zahlungsverzug_tage, coalesce(a.partial, 0) AS mahnungen,
  CASE WHEN c_acctbal < 2000 THEN 1 ELSE 0 END AS wettbewerber_aktiv, CASE WHEN c_acctbal < 500 THEN c_mktsegment ELSE 'nan' END AS wettbewerber_produktgruppe,
  coalesce(a.tax, 0) AS preisanpassung_pct, coalesce(a.lines, 0) AS angebote_ytd, coalesce(a.lines_v, 0) AS angebote_vorjahr, coalesce(a.months, 0) AS kontakte_ytd, coalesce(a.months_v, 0) AS kontakte_vorjahr,
  coalesce(k.kinds, 0) * 100 / 6 AS portfolio_abdeckung_pct, CAST((6 - coalesce(k.kinds, 0)) * 1000 AS DOUBLE) AS produktluecken_wert, coalesce(DATEDIFF(a.last_day, {NOW}), 365) AS letzter_kontakt_tage,
  coalesce(a.open_orders, 0) AS offene_opps, CAST(coalesce(a.open_cents, 0) AS DOUBLE) / 100 AS opp_wert, coalesce(a.returned, 0) AS service_tickets, coalesce(a.returned_v, 0) AS service_tickets_vorquartal,
  coalesce(a.months, 0) AS kontakte_aktiv, 12 AS kontakte_gesamt, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Neubau' ELSE '—' END AS trigger_event
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey LEFT JOIN (
  SELECT o_custkey, SUM(CASE WHEN y = {CURRENT} THEN rev END) AS rev, SUM(CASE WHEN y = {PREVIOUS} THEN rev END) AS rev_v,
    COUNT(CASE WHEN y = {CURRENT} THEN 1 END) AS orders, COUNT(CASE WHEN y = {PREVIOUS} THEN 1 END) AS orders_v,
    CAST(SUM(CASE WHEN y = {CURRENT} THEN returned ELSE 0 END) AS BIGINT) AS returned, CAST(SUM(CASE WHEN y = {PREVIOUS} THEN returned ELSE 0 END) AS BIGINT) AS returned_v,
    CAST(SUM(CASE WHEN y = {CURRENT} THEN taken ELSE 0 END) AS BIGINT) AS taken, CAST(SUM(CASE WHEN y = {PREVIOUS} THEN taken ELSE 0 END) AS BIGINT) AS taken_v,
    COUNT(CASE WHEN y = {CURRENT} AND o_orderpriority LIKE '1%' THEN 1 END) AS urgent, COUNT(CASE WHEN y = {CURRENT} AND o_orderstatus = 'P' THEN 1 END) AS partial,
    MAX(CASE WHEN y = {CURRENT} THEN tax END) AS tax, CAST(SUM(CASE WHEN y = {CURRENT} THEN lines ELSE 0 END) AS BIGINT) AS lines, CAST(SUM(CASE WHEN y = {PREVIOUS} THEN lines ELSE 0 END) AS BIGINT) AS lines_v,
    CAST(bit_count(bit_or(CASE WHEN y = {CURRENT} THEN 1 << m ELSE 0 END)) AS BIGINT) AS months, CAST(bit_count(bit_or(CASE WHEN y = {PREVIOUS} THEN 1 << m ELSE 0 END)) AS BIGINT) AS months_v,
    COUNT(CASE WHEN y = {CURRENT} AND o_orderstatus = 'O' THEN 1 END) AS open_orders, SUM(CASE WHEN y = {CURRENT} AND o_orderstatus = 'O' THEN cents END) AS open_cents, MAX(day) AS last_day
  FROM (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS y, CAST(month(o_orderdate) AS INT) AS m FROM {{orders}} WHERE CAST(o_orderdate AS DATE) <= {NOW}) o
  JOIN (SELECT l_orderkey, SUM({REV}) AS rev, COUNT(*) AS lines, COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned, COUNT(CASE WHEN l_returnflag = 'A' THEN 1 END) AS taken, MAX(round(l_tax * 100)) AS tax,
    SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM {{lineitem}} GROUP BY l_orderkey) l ON o_orderkey = l_orderkey GROUP BY o_custkey) a ON c_custkey = a.o_custkey
LEFT JOIN (SELECT o_custkey, COUNT(CASE WHEN now > 0 THEN 1 END) AS kinds, COUNT(CASE WHEN before > 0 THEN 1 END) AS kinds_v FROM (
    SELECT o_custkey, p_type, MAX(CASE WHEN year(o_orderdate) = {CURRENT} THEN 1 ELSE 0 END) AS now, MAX(CASE WHEN year(o_orderdate) = {PREVIOUS} THEN 1 ELSE 0 END) AS before
    FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey JOIN {{part}} ON l_partkey = p_partkey WHERE year(o_orderdate) BETWEEN {PREVIOUS} AND {CURRENT} AND CAST(o_orderdate AS DATE) <= {NOW} GROUP BY o_custkey, p_type) t GROUP BY o_custkey) k ON c_custkey = k.o_custkey""",
    "deals": """
SELECT o_orderkey AS opp_id, o_custkey AS kunde_id, n_name AS branche, c_mktsegment AS vertriebsmitarbeiter, o_orderpriority AS produkt_id, substring(o_orderpriority, 3) AS stage, o_totalprice AS deal_wert,
  DATEDIFF(CAST(o_orderdate AS DATE), DATE '2001-08-01') AS tage_in_stage, DATEDIFF(CAST(o_orderdate AS DATE), DATE '2001-08-01') % 45 AS letzter_kontakt_tage,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'Rival' ELSE '—' END AS wettbewerber, CAST(substring(o_orderpriority, 1, 1) AS INT) * 5 AS rabatt_gefordert_pct, CAST(substring(o_orderpriority, 1, 1) AS INT) * 10 + 20 AS crm_probability,
  CASE o_orderstatus WHEN 'F' THEN 'gewonnen' WHEN 'P' THEN 'verloren' ELSE 'offen' END AS status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "contacts": """
SELECT l_orderkey AS opp_id, CASE l_linenumber % 5 WHEN 0 THEN 'CFO / Einkaufsleitung' WHEN 1 THEN 'Technik' WHEN 2 THEN 'Geschäftsführung' WHEN 3 THEN 'Einkauf' ELSE 'Anwender' END AS rolle,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS involviert, CASE l_returnflag WHEN 'R' THEN 'negativ' WHEN 'A' THEN 'neutral' ELSE 'positiv' END AS sentiment, CASE WHEN l_discount > 0.085 THEN 1 ELSE 0 END AS wettbewerber_kontakt
FROM {lineitem}""",
    "components": """
SELECT p_brand AS komponente_id, p_brand AS komponente_name, CASE CAST(substring(p_brand, 7, 2) AS INT) % 5 WHEN 1 THEN 'Basis' WHEN 2 THEN 'Antrieb' WHEN 3 THEN 'Steuerung' WHEN 4 THEN 'Gehäuse' ELSE 'Zubehör' END AS kategorie,
  MAX(p_retailprice) AS listenpreis, MIN(p_retailprice) AS herstellkosten
FROM {part} GROUP BY p_brand""",
    "compatible": """
SELECT DISTINCT x.p_brand AS a, y.p_brand AS b
FROM {lineitem} l JOIN {part} x ON l.l_partkey = x.p_partkey JOIN {lineitem} m ON l.l_orderkey = m.l_orderkey JOIN {part} y ON m.l_partkey = y.p_partkey WHERE x.p_brand <> y.p_brand""",
    "series": """
SELECT p_type, CAST(l_shipdate AS DATE) AS datum, SUM(l_quantity) AS menge FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_type, CAST(l_shipdate AS DATE)""",
    "companies": """
SELECT firma_id, concat(chr(97 + CAST(h % 26 AS INT)), translate(CAST(h % 99991 AS STRING), '0123456789', 'aetoslrnid'), ' ', translate(CAST(h * 31 % 999983 AS STRING), '0123456789', 'ubkegmhpas'),
    CASE firma_id % 4 WHEN 0 THEN ' GmbH' WHEN 1 THEN ' AG' WHEN 2 THEN ' GmbH & Co. KG' ELSE '' END, CASE firma_id % 8 WHEN 1 THEN 'x' ELSE '' END) AS firma_name,
  CAST(10000 + h * 37 % 89989 AS STRING) AS plz, translate(CAST(c_nationkey * 48611 + 70001 AS STRING), '0123456789', 'aurenbilos') AS ort, c_mktsegment AS branche
FROM (SELECT c_custkey AS firma_id, c_nationkey, c_mktsegment, CAST(c_custkey - CASE WHEN c_custkey % 8 = 1 THEN 1 ELSE 0 END AS BIGINT) * 7919 + 104729 AS h FROM {customer}) c""",
    "results": """
SELECT event_id AS id, event_type AS project_id, value / 500 AS anomaly_score, CASE WHEN value / 500 > CASE WHEN event_type IN ('click', 'signup') THEN 0.15 ELSE 0.2 END THEN 'NOK' ELSE 'OK' END AS decision, value AS inference_ms, CAST(EPOCH(ts) AS DOUBLE) AS created_at FROM {events}""",
    "samples": """
SELECT user_id AS sample_id, ts, value FROM {events}""",
}


def spark_text(role: str) -> str:
    return ROLES[role].replace("DATEDIFF(", "datediff(DAY, ").replace("EPOCH(ts)", "unix_micros(CAST(ts AS TIMESTAMP)) / 1000000")


def duck_text(role: str) -> str:
    names = {t: t for t in TABLES}
    return ROLES[role].format(**names).replace("DATEDIFF(", "datediff('day', ")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a role, from the tables in sf_dir."""
    text = spark_text(name)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)
