"""Deals as a graph of people, products and rivals: risk-adjusted probability of winning.

Input: deals (opp_id, branche, deal_wert, tage_in_stage, letzter_kontakt_tage, wettbewerber,
rabatt_gefordert_pct, crm_probability, status, ...) and contacts (opp_id, rolle, involviert, sentiment,
wettbewerber_kontakt). Contacts are aggregated by deal before they are joined, so a deal's row count stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import clamp, cleaned, even, grouped, number, whole
from tallyloom.sources.session import cut

FINANCE_FROM, MANAGEMENT_FROM = 150_000.0, 250_000.0
CFO, MANAGEMENT, TECHNICAL = ("CFO / Einkaufsleitung",), ("Geschäftsführung",), ("Technik",)
FALLBACK_RATE, FALLBACK_DAYS = 0.45, 30.0

#: Risk, action, what it takes, deadline.
ACTIONS = (
    ("Finanzfreigabe nicht eingebunden", "CFO-Termin vereinbaren", "Business Case mit TCO-Rechnung aufbereiten und Finanzentscheider direkt einbinden.", "innerhalb 48 h"),
    ("Wettbewerber im Buying Center aktiv", "Wettbewerbs-Battlecard einsetzen", "Differenzierung gegenüber dem Wettbewerber schriftlich adressieren und technische Entscheider erneut überzeugen.", "innerhalb 48 h"),
    ("Deal steht still", "Deal reaktivieren", "Verbindlichen nächsten Schritt mit Datum vereinbaren – sonst Stage zurückstufen.", "innerhalb 3 Tagen"),
    ("Kontakt eingeschlafen", "Kontakt reaktivieren", "Persönlichen Termin vereinbaren und Entscheidungsstand verifizieren.", "innerhalb 48 h"),
    ("Kein Zugang zur Geschäftsführung", "Zugang zur Geschäftsleitung schaffen", "Über bestehenden Sponsor eine Vorstellung auf Geschäftsführungsebene erwirken.", "diese Woche"),
    ("Technische Entscheidung offen", "Technische Validierung ansetzen", "Proof of Concept oder Referenzbesuch mit dem technischen Entscheider terminieren.", "diese Woche"),
    ("Hoher Rabattdruck", "Wertargumentation stärken", "Statt Preisnachlass Zusatzleistungen anbieten (Service, Schulung, Verfügbarkeit).", "vor nächstem Angebot"),
    ("Widerstand im Buying Center", "Einwände strukturiert adressieren", "Einzelgespräch mit dem kritischen Stakeholder führen und Bedenken dokumentieren.", "innerhalb 1 Woche"),
)
NO_RISK = ("Abschluss forcieren", "Keine wesentlichen Risikosignale. Verbindliches Abschlussdatum vereinbaren.", "diese Woche")
OTHER_RISK = ("Deal-Review durchführen", "Risikosignale mit dem Vertriebsleiter besprechen.", "diese Woche")


def reference_rates(deals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of the overall win rate and the median days in stage of open deals; and the win rate of each branch."""
    closed = deals.where(F.col("status").isin("gewonnen", "verloren")).withColumn("_won", (F.col("status") == "gewonnen").cast("double"))
    overall = deals.agg(
        F.coalesce(F.avg(F.when(F.col("status").isin("gewonnen", "verloren"), (F.col("status") == "gewonnen").cast("double"))), F.lit(FALLBACK_RATE)).alias("_rate"),
        F.coalesce(F.median(F.when(F.col("status") == "offen", F.col("tage_in_stage").cast("double"))), F.lit(FALLBACK_DAYS)).alias("_median"),
    )
    return overall, closed.groupBy("branche").agg(F.avg("_won").alias("_branch_rate"))


def buying_centre(contacts: DataFrame) -> DataFrame:
    """What a deal's involved contacts say, one row a deal."""
    there = F.col("involviert") == 1
    any_of = lambda c: F.coalesce(F.bool_or(there & c), F.lit(False))
    named = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(there & c, F.col("rolle")))), ", ")
    return contacts.groupBy("opp_id").agg(
        any_of(F.col("rolle").isin(*CFO)).alias("_cfo"), any_of(F.col("rolle").isin(*MANAGEMENT)).alias("_gf"), any_of(F.col("rolle").isin(*TECHNICAL)).alias("_technik"),
        F.count_if(there & (F.col("wettbewerber_kontakt") == 1)).alias("_rivals"), F.count_if(there & (F.col("sentiment") == "negativ")).alias("_negative"),
        named(F.col("wettbewerber_kontakt") == 1).alias("_rival_roles"), named(F.col("sentiment") == "negativ").alias("_negative_roles"),
    )


def scored(deals: DataFrame, contacts: DataFrame, texts: bool = False) -> DataFrame:
    """Open deals with faktoren (array of titel and delta, with texts also text), graph probability, risks, light, expected value and action."""
    overall, branch = reference_rates(deals)
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    open_deals = deals.where(F.col("status") == "offen").join(buying_centre(contacts), "opp_id", "left").join(branch, "branche", "left").crossJoin(F.broadcast(overall))
    value, contact, discount, days = number("deal_wert"), number("letzter_kontakt_tage"), number("rabatt_gefordert_pct"), number("tage_in_stage")
    in_centre = F.coalesce("_rivals", F.lit(0)) > 0
    rival = cleaned("wettbewerber") != ""
    diff = (F.coalesce("_branch_rate", "_rate") - F.col("_rate")) * 100
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("—")) for p in parts])
    percent = lambda x: said(whole(x * 100), " %")
    stage = F.col("stage").cast("string") if "stage" in deals.columns else F.lit(None).cast("string")
    rules = [
        ("Finanzfreigabe nicht eingebunden", no("_cfo") & (value >= FINANCE_FROM), F.lit(-14.0), said("Bei ", grouped(value), " € Deal-Wert ist keine CFO-/Einkaufsleitung im Buying Center aktiv. Historisch scheitern Deals dieser Größe ohne Finanzfreigabe deutlich häufiger.")),
        ("Finanzfreigabe eingebunden", yes("_cfo"), F.lit(8.0), F.lit("CFO / Einkaufsleitung ist aktiv im Entscheidungsprozess.")),
        ("Kein Zugang zur Geschäftsführung", no("_gf") & (value >= MANAGEMENT_FROM), F.lit(-7.0), F.lit("Deals über 250.000 € werden in der Regel auf Geschäftsführungsebene entschieden.")),
        ("Technische Entscheidung offen", no("_technik"), F.lit(-6.0), F.lit("Kein technischer Ansprechpartner involviert – die Lösungsvalidierung fehlt.")),
        ("Wettbewerber im Buying Center aktiv", in_centre, F.lit(-16.0), said("Direkter Wettbewerberkontakt über: ", F.col("_rival_roles"), ". Wettbewerber: ", F.col("wettbewerber"), ".")),
        ("Wettbewerber im Rennen", ~in_centre & rival, F.lit(-6.0), said(F.col("wettbewerber"), " bietet ebenfalls an, hat aber keinen erkennbaren Draht ins Buying Center.")),
        ("Deal steht still", days > F.col("_median") * 1.8, F.lit(-12.0), said(whole(days), " Tage in Stage „", stage, "“ – Median liegt bei ", whole(F.col("_median")), " Tagen.")),
        ("Kontakt eingeschlafen", contact > 30, F.lit(-10.0), said("Letzter Kontakt vor ", whole(contact), " Tagen. Ab 30 Tagen sinkt die Abschlussquote messbar.")),
        ("Enger Kundenkontakt", contact <= 7, F.lit(5.0), said("Letzter Kontakt vor ", whole(contact), " Tagen – der Deal ist aktiv in Bewegung.")),
        ("Hoher Rabattdruck", discount >= 18, F.lit(-8.0), said(whole(discount), " % Nachlass gefordert – Indiz für reinen Preiswettbewerb statt Wertargumentation.")),
        ("Widerstand im Buying Center", F.coalesce("_negative", F.lit(0)) > 0, F.lit(-9.0), said("Negatives Sentiment bei: ", F.col("_negative_roles"), ".")),
        (said("Branchen-Historie ", F.col("branche")), F.abs(diff) >= 8, even(diff * 0.4), said("Win-Rate in dieser Branche: ", percent(F.coalesce("_branch_rate", "_rate")), " (Gesamt: ", percent(F.col("_rate")), ").")),
    ]
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    factors = F.filter(F.array(*[F.when(cond, F.struct(F.lit(i).alias("pos"), column(title).alias("titel"), delta.alias("delta"), *[text.alias("text")] * texts)) for i, (title, cond, delta, text) in enumerate(rules)]), lambda f: f.isNotNull())
    worst_first = lambda a, b: F.when(a["delta"] < b["delta"], -1).when(a["delta"] > b["delta"], 1).otherwise(a["pos"] - b["pos"])
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    crm = number("crm_probability")
    out = open_deals.withColumn("faktoren", factors).withColumns(
        {
            "p_graph": clamp(crm + F.aggregate("faktoren", F.lit(0.0), lambda s, f: s + f["delta"]), 3.0, 96.0),
            "p_stillstand": clamp((days / F.greatest(F.col("_median"), F.lit(1.0)) - 1) * 32 + 18 + contact * 0.55, 4.0, 95.0),
            "p_wettbewerb": clamp(F.when(rival, 34.0).otherwise(5.0) + one(in_centre) * 26 + (discount - 10) * 0.9, 2.0, 92.0),
            "p_rabatt": clamp(discount * 2.6 + one(rival) * 16 + one(in_centre) * 10, 5.0, 95.0),
            "_risks": F.array_sort(F.filter("faktoren", lambda f: f["delta"] < 0), worst_first),
        }
    )
    todo = F.create_map(*[x for t, *do in ACTIONS for x in (F.lit(t), F.struct(*[F.lit(d).alias(n) for n, d in zip(("aktion", "detail", "frist"), do)]))])
    fixed = lambda do: F.struct(*[F.lit(d).alias(n) for n, d in zip(("aktion", "detail", "frist"), do)])
    top = F.get(F.col("_risks"), F.lit(0))["titel"]
    out = out.withColumns(
        {
            "ampel": F.when(F.col("p_graph") < crm - 12, "rot").when(F.col("p_graph") < crm - 4, "gelb").otherwise("gruen"),
            "erwartungswert": even(value * F.col("p_graph") / 100),
            "top_risiko": top,
            "_todo": F.when(top.isNull(), fixed(NO_RISK)).otherwise(F.coalesce(todo[top], fixed(OTHER_RISK))),
        }
    )
    out = out.withColumns({c: F.col("_todo")[c] for c in ("aktion", "detail", "frist")})
    return out.drop("_cfo", "_gf", "_technik", "_rivals", "_negative", "_rival_roles", "_negative_roles", "_branch_rate", "_rate", "_median", "_risks", "_todo")


def factors(scores: DataFrame) -> DataFrame:
    return scores.select("opp_id", F.explode("faktoren").alias("f")).select("opp_id", "f.titel", "f.delta")


def sentences(deals: DataFrame, contacts: DataFrame) -> DataFrame:
    """A row for each factor of an open deal: its title and sentence."""
    return scored(deals, contacts, texts=True).select("opp_id", F.explode("faktoren").alias("f")).select("opp_id", "f.titel", "f.text")


def kpis(scores: DataFrame) -> DataFrame:
    value = number("deal_wert")
    return scores.agg(
        F.count("*").alias("deals"), F.coalesce(F.sum(value.cast("decimal(28,2)")).cast("double"), F.lit(0.0)).alias("pipeline"),
        F.coalesce(F.sum("erwartungswert"), F.lit(0.0)).alias("erwartungswert"), F.coalesce(F.sum(even(value * number("crm_probability") / 100)), F.lit(0.0)).alias("crm_wert"),
        F.count_if(F.col("ampel") == "rot").alias("rot"), F.count_if(F.col("ampel") == "gelb").alias("gelb"), F.count_if(F.col("ampel") == "gruen").alias("gruen"),
    )


def similar(open_deals: DataFrame, history: DataFrame, n: int = 5) -> DataFrame:
    """For each open deal the n closed deals of its branch nearest in value, then of the smallest id (all branches where it has none).

    Closed deals of a branch and value become one level with its n smallest ids. Levels and open deals are dealt over range partitions
    by branch and value; a level's position is its place within its part plus the levels of the parts before. For each open deal
    the n levels at or below its value and the n above hold the n nearest, whatever the ties, and are found by position.
    No branch is in one task, and a value that many deals have counts n times at most. Deals without a value have no neighbours.
    """
    closed = history.select(F.col("branche").alias("_pool"), F.col("opp_id").cast("string").alias("alt_id"), F.col("deal_wert").cast("double").alias("v"), F.col("status").alias("alt_status")).where("v IS NOT NULL")
    asked = open_deals.select("opp_id", F.col("branche").alias("_pool"), F.col("deal_wert").cast("double").alias("v")).where("v IS NOT NULL")
    known = closed.where("_pool IS NOT NULL").select("_pool").distinct()
    own, rest = asked.join(known, "_pool", "left_semi"), asked.join(known, "_pool", "left_anti").withColumn("_pool", F.lit(None).cast("string"))
    if not rest.isEmpty():
        closed = closed.where("_pool IS NOT NULL").unionByName(closed.withColumn("_pool", F.lit(None).cast("string")))
    first = Window.partitionBy("_pool", "v").orderBy("alt_id")
    fewest = closed.withColumn("_nr", F.row_number().over(first)).where(F.col("_nr") <= n)
    levels = fewest.groupBy("_pool", "v").agg(F.sort_array(F.collect_list(F.struct("alt_id", "alt_status"))).alias("_deals"))
    line = levels.select("_pool", "v", "_deals", F.lit(None).cast(open_deals.schema["opp_id"].dataType).alias("opp_id"), F.lit(0).alias("_ask"))
    line = line.unionByName(own.unionByName(rest).select("_pool", "v", F.lit(None).cast(levels.schema["_deals"].dataType).alias("_deals"), "opp_id", F.lit(1).alias("_ask")))
    line = cut(line.repartitionByRange("_pool", "v", "_ask", "opp_id").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", "_pool").orderBy("v", "_ask", "opp_id").rowsBetween(Window.unboundedPreceding, 0)
    # a row for each part and branch: small however large a branch is
    sizes = line.groupBy("_part", "_pool").agg(F.sum(1 - F.col("_ask")).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_pool").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_part").alias("_p"), F.col("_pool").alias("_b"), before.alias("_before"))
    placed = line.withColumn("_in", F.sum(1 - F.col("_ask")).over(inside)).join(offsets, (F.col("_part") == F.col("_p")) & F.col("_pool").eqNullSafe(F.col("_b"))).withColumn("_pos", F.col("_in") + F.col("_before"))
    steps = F.explode(F.sequence(F.col("_pos") - (n - 1), F.col("_pos") + n))
    want = placed.where("_ask = 1").select("_pool", "opp_id", F.col("v").alias("wert"), steps.alias("_pos"))
    have = placed.where("_ask = 0").select(F.col("_pool").alias("_b"), F.col("_pos").alias("_q"), F.col("v").alias("alt_wert"), "_deals")
    near = want.join(have, F.col("_pool").eqNullSafe(F.col("_b")) & (F.col("_pos") == F.col("_q"))).select("opp_id", "wert", "alt_wert", F.explode("_deals").alias("_d"))
    near = near.select("opp_id", "alt_wert", "_d.*", F.abs(F.col("alt_wert") - F.col("wert")).alias("abstand"))
    best = Window.partitionBy("opp_id").orderBy("abstand", "alt_id")
    return near.withColumn("nr", F.row_number().over(best)).where(F.col("nr") <= n).select("opp_id", "nr", "alt_id", "alt_wert", "alt_status", "abstand")


def graph(deals: DataFrame, contacts: DataFrame) -> DataFrame:
    """Typed edges (src, dst, rel) between deals, customers, products, sellers, rivals and involved contacts."""
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    deal = node("opp", "opp_id")
    named = deals.withColumn("_rival", cleaned("wettbewerber"))
    parts = [
        named.select(deal.alias("src"), node("kunde", "kunde_id").alias("dst"), F.lit("GEHOERT_ZU").alias("rel")),
        named.select(deal.alias("src"), node("produkt", "produkt_id").alias("dst"), F.lit("BETRIFFT").alias("rel")),
        named.select(node("rep", "vertriebsmitarbeiter").alias("src"), deal.alias("dst"), F.lit("BETREUT").alias("rel")),
        named.where("_rival <> ''").select(node("rival", "_rival").alias("src"), deal.alias("dst"), F.lit("KONKURRIERT_UM").alias("rel")),
        contacts.where("involviert = 1").join(deals.select("opp_id"), "opp_id", "left_semi").select(F.concat(F.lit("kontakt:"), F.col("opp_id").cast("string"), F.lit(":"), F.col("rolle")).alias("src"), deal.alias("dst"), F.lit("INVOLVIERT").alias("rel")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def network(edges: DataFrame) -> DataFrame:
    """One row: nodes and edges of a typed graph."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.count_distinct("node").alias("n_knoten"))
    return edges.agg(F.count("*").alias("n_kanten")).crossJoin(F.broadcast(nodes)).select("n_knoten", "n_kanten")


def ego(edges: DataFrame, node: str) -> DataFrame:
    """The edges among a node and its neighbours."""
    touching = edges.where((F.col("src") == node) | (F.col("dst") == node))
    members = touching.select(F.explode(F.array("src", "dst")).alias("m")).distinct()
    return edges.join(members.select(F.col("m").alias("src")), "src", "left_semi").join(members.select(F.col("m").alias("dst")), "dst", "left_semi").select("src", "dst", "rel")
