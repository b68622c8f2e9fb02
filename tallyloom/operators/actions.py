"""Next best action: account signals, weighted by urgency and value, ranked over all accounts.

Input: one row an account. All is one projection but for the greatest score, which scales the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import cleaned, even, exact_sum, grouped, growth, number, signed, whole
from tallyloom.sources.session import cut

#: Signal, weight, urgency, label, action.
SIGNALS = (
    ("churn", 30, 3, "Umsatzrückgang", "Eskalationsgespräch mit Einkaufsleitung"),
    ("wettbewerb", 28, 3, "Wettbewerbsdruck", "Verteidigungsgespräch führen"),
    ("deal_risk", 26, 3, "Deal in Gefahr", "Offene Opportunity reaktivieren"),
    ("trigger", 24, 2, "Expansionssignal", "Termin innerhalb 48 h vereinbaren"),
    ("cross_sell", 18, 1, "Cross-Sell-Chance", "Produkterweiterung vorstellen"),
    ("service", 16, 2, "Service-Eskalation", "Service-Review ansetzen"),
    ("beziehung", 14, 2, "Beziehungsrisiko", "Beziehungsnetz neu aufbauen"),
)
#: What to do about the dominant signal; {anlass} and {luecken} are the account's.
DETAILS = {
    "churn": "Ursachen des Volumenrückgangs klären, Wettbewerbssituation offen ansprechen und Rahmenvereinbarung neu verhandeln.",
    "wettbewerb": "Battlecard gegen den aktiven Wettbewerber einsetzen, technische Differenzierung und Servicequalität in den Vordergrund stellen.",
    "deal_risk": "Verbindlichen nächsten Schritt mit Datum vereinbaren und Entscheidungsstand im Buying Center verifizieren.",
    "trigger": "{anlass} – Bedarf frühzeitig besetzen, bevor der Wettbewerb reagiert. Kapazitätserweiterung und Servicepaket anbieten.",
    "cross_sell": "Portfolio-Lücken im Wert von {luecken} € gezielt adressieren – vergleichbare Kunden nutzen diese Produkte bereits.",
    "service": "Gemeinsame Ticket-Analyse mit Technik und Kunde, danach Upgrade auf höherwertigen Servicevertrag anbieten.",
    "beziehung": "Neue Ansprechpartner identifizieren und persönlich vorstellen, bevor der Account beziehungslos wird.",
}
NO_TRIGGER = "Expansionssignal erkannt"
DEADLINES = {3: "innerhalb 48 h", 2: "diese Woche", 1: "in 2 Wochen"}


def detected() -> dict[str, tuple[Column, Column, Column]]:
    """For each signal: whether it is there, the value at stake and its strength."""
    n = number
    now, before, contact = n("umsatz_ytd"), n("umsatz_vorjahr"), n("letzter_kontakt_tage")
    change = growth(now, before)
    rival = n("wettbewerber_aktiv").cast("int") != 0
    deals, worth = n("offene_opps"), n("opp_wert")
    gap, cover = n("produktluecken_wert"), n("portfolio_abdeckung_pct")
    tickets, old = n("service_tickets"), n("service_tickets_vorquartal")
    active, people = n("kontakte_aktiv"), n("kontakte_gesamt")
    asleep = (deals > 0) & (contact > 25)
    return {
        "churn": ((before > 0) & (change <= -12), before - now, F.least(F.lit(2.0), F.abs(change) / 15)),
        "wettbewerb": (rival, F.when(change < 0, now * 0.35).otherwise(now * 0.18), F.when(change < 0, 1.6).otherwise(1.0)),
        "deal_risk": (asleep | ((deals > 0) & (worth > 150_000)), F.when(asleep, worth).otherwise(worth * 0.5), F.when(asleep, F.least(F.lit(2.0), contact / 30)).otherwise(0.8)),
        "trigger": (cleaned("trigger_event") != "", now * 0.30, F.lit(1.5)),
        "cross_sell": ((gap > 0) & (cover < 70), gap, F.when(change > 0, 1.2).otherwise(0.8)),
        "service": ((old > 0) & (tickets > old * 1.6), now * 0.20, F.least(F.lit(1.8), tickets / F.greatest(old, F.lit(1.0)) / 2)),
        "beziehung": ((people > 0) & (F.try_divide(active, people) < 0.65), now * 0.15, 1.0 + (people - active) * 0.2),
    }


def texts() -> dict[str, Column]:
    """Each signal's sentence, as reports show it."""
    n = number
    now, before, contact, worth = n("umsatz_ytd"), n("umsatz_vorjahr"), n("letzter_kontakt_tage"), n("opp_wert")
    change = growth(now, before)
    tickets, old, active, people = n("service_tickets"), n("service_tickets_vorquartal"), n("kontakte_aktiv"), n("kontakte_gesamt")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    deals = said(whole(n("offene_opps")), " offene Opportunity(s) über ", grouped(worth), " €")
    return {
        "churn": said("Umsatz ", signed(change), " % gegenüber Vorjahr (", grouped(before - now), " € Rückgang)."),
        "wettbewerb": F.when(change < 0, "Wettbewerber aktiv im Account bei gleichzeitig sinkendem Bestellvolumen.").otherwise("Wettbewerber ist im Account aktiv – Position verteidigen."),
        "deal_risk": F.when(contact > 25, said(deals, ", aber seit ", whole(contact), " Tagen kein Kontakt.")).otherwise(said(deals, " in aktiver Bearbeitung.")),
        "trigger": said(cleaned("trigger_event"), " – konkreter Anlass für ein Erweiterungsgespräch."),
        "cross_sell": said("Portfolio-Abdeckung nur ", whole(n("portfolio_abdeckung_pct")), " % – Produktlücken im Wert von ", grouped(n("produktluecken_wert")), " €."),
        "service": said("Service-Tickets von ", whole(old), " auf ", whole(tickets), " gestiegen (+", whole((F.try_divide(tickets, old) - 1) * 100), " %) – Zufriedenheitsrisiko."),
        "beziehung": said("Nur ", whole(active), " von ", whole(people), " Kontakten aktiv – ", whole(people - active), " Ansprechpartner nicht mehr erreichbar."),
    }


def ranked(accounts: DataFrame, rep: str | None = None, rep_col: str = "vertriebsmitarbeiter") -> DataFrame:
    """Accounts with a signal: signals by their part, value, raw score, score of 0 to 100, dominant signal, action, deadline, rank.

    Scores are scaled over all accounts before one representative's are chosen.
    """
    found = detected()
    every = F.array(*[F.when(found[k][0], F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key"), F.lit(u).alias("dringlichkeit"), found[k][1].alias("wert"), (found[k][2] * (w * u)).alias("teil"))) for i, (k, w, u, _, _) in enumerate(SIGNALS)])
    order = lambda a, b: F.when(a["teil"] > b["teil"], -1).when(a["teil"] < b["teil"], 1).otherwise(a["pos"] - b["pos"])
    actions = F.create_map(*[F.lit(x) for k, _, _, _, action in SIGNALS for x in (k, action)])
    deadlines = F.create_map(*[F.lit(x) for u, d in DEADLINES.items() for x in (u, d)])
    # written once: all that follows reads the found signals, and the accounts are used twice
    out = cut(accounts.withColumn("_s", F.filter(every, lambda s: s.isNotNull()))).where(F.size("_s") > 0)
    value = F.aggregate("_s", F.lit(0.0), lambda s, x: s + x["wert"])
    out = out.withColumns({"wert": value, "_sum": F.aggregate("_s", F.lit(0.0), lambda s, x: s + x["teil"]), "signale": F.array_sort("_s", order)})
    out = out.withColumn("roh", even(F.col("_sum") * (F.log10(F.greatest(F.col("wert"), F.lit(1000.0)) / 1000 + 1) + 0.4), 1))
    most = out.agg(F.max("roh").alias("_max"))  # one row
    out = out.crossJoin(F.broadcast(most)).withColumns(
        {
            "score": F.when(F.col("_max") > 0, even(F.col("roh") / F.col("_max") * 100)).otherwise(0.0),
            "dringlichkeit": F.array_max(F.transform("_s", lambda s: s["dringlichkeit"])),
            "dominant": F.col("signale")[0]["key"],
        }
    )
    trigger = cleaned("trigger_event")
    details = F.create_map(*[F.lit(x) for k, d in DETAILS.items() for x in (k, d)])
    detail = F.replace(F.replace(details[F.col("dominant")], F.lit("{anlass}"), F.when(trigger != "", trigger).otherwise(NO_TRIGGER)), F.lit("{luecken}"), grouped(number("produktluecken_wert")))
    out = out.withColumns({"aktion": actions[F.col("dominant")], "detail": detail, "frist": deadlines[F.col("dringlichkeit")]}).drop("_s", "_sum", "_max")
    return out if rep is None else out.where(F.col(rep_col) == rep)


def top(scored: DataFrame, n: int) -> DataFrame:
    """The n most urgent actions with their rank: only n rows are ever ordered in one place."""
    best = scored.orderBy(F.desc("dringlichkeit"), F.desc("score"), "kunde_id").limit(n)
    return best.withColumn("rang", F.row_number().over(Window.orderBy(F.desc("dringlichkeit"), F.desc("score"), "kunde_id")))


def sentences(accounts: DataFrame) -> DataFrame:
    """A row for each signal that an account shows: its sentence."""
    found, words = detected(), texts()
    rows = F.array_compact(F.array(*[F.when(found[k][0], F.struct(F.lit(k).alias("signal"), words[k].alias("text"))) for k in words]))
    return accounts.select("kunde_id", F.explode(rows).alias("s")).select("kunde_id", "s.*")


def distribution(scored: DataFrame) -> DataFrame:
    """How many accounts show each signal."""
    return scored.select(F.explode("signale.key").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


def kpis(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("aktionen"), F.count_if(F.col("dringlichkeit") == 3).alias("dringend"), F.coalesce(exact_sum(F.col("wert"), 6), F.lit(0.0)).alias("wert"), even(F.avg("score"), 1).alias("avg_score"))
