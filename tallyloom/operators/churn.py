"""Churn: eleven signals of an account, their weighted sum, revenue at risk and what to do.

Input: one row an account with the columns named below (missing numbers count as 0). All is one
projection; distributions and KPIs are aggregates over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.exprs import clamp, cleaned, even, grouped, growth, number, signed, tier, whole

#: What to do about the dominant signal; {gruppe} is the rival's product group.
DETAILS = {
    "umsatz": "Volumenrückgang auf Geschäftsführungsebene adressieren. Rahmenvertrag, Mengenstaffel und Lieferperformance gemeinsam auf den Tisch legen.",
    "bestellfreq": "Rückgang der Bestellfrequenz deutet auf abgewanderte Teilbedarfe. Abrufvereinbarung oder Konsignationslager anbieten.",
    "letzter_kauf": "Der Kunde hat seit Monaten nicht bestellt. Persönlicher Besuch statt E-Mail – klären, ob bereits ein Wettbewerber liefert.",
    "wettbewerb": "Wettbewerber gewinnt Anteile in {gruppe}. Battlecard einsetzen, Referenzen und Total-Cost-Argumentation gezielt gegenhalten.",
    "portfolio": "Der Kunde hat Produktgruppen abbestellt. Ursache klären: Preis, Qualität oder Wettbewerber – und ein Rückgewinnungsangebot aufsetzen.",
    "service": "Gestiegene Servicefälle und Reklamationen sind der häufigste Vorläufer von Abwanderung. Gemeinsames Review mit Technik und Qualitätssicherung.",
    "ansprechpartner": "Nach Ansprechpartnerwechseln fehlt die gewachsene Bindung. Neue Kontakte aktiv vorstellen und Entscheidungswege neu kartieren.",
    "zahlung": "Zahlungsverzug kann Liquiditätsprobleme oder Unzufriedenheit signalisieren. Gemeinsam mit dem Innendienst klären, bevor der Kunde still abwandert.",
    "angebote": "Deutlich weniger Anfragen bedeutet, dass der Bedarf woanders platziert wird. Bedarfsplanung des Kunden aktiv erfragen.",
    "preis": "Die Preisanhebung trifft auf aktiven Wettbewerb. Wertargumentation und Mehrjahresvereinbarung als Alternative zum Nachlass vorbereiten.",
    "kommunikation": "Die Kommunikation ist stark zurückgegangen. Feste Besuchsfrequenz vereinbaren, bevor die Beziehung abreißt.",
}
NO_GROUP = "der betroffenen Produktgruppe"

#: Signal, weight, label, action.
SIGNALS = (
    ("umsatz", 18, "Umsatzentwicklung", "Executive Review ansetzen"),
    ("bestellfreq", 12, "Bestellfrequenz", "Bestellprozess prüfen"),
    ("letzter_kauf", 12, "Letzter Einkauf", "Reaktivierung sofort"),
    ("wettbewerb", 12, "Wettbewerbsdruck", "Produktgruppe {gruppe} verteidigen"),
    ("portfolio", 10, "Produktportfolio", "Abbestellte Produkte zurückgewinnen"),
    ("service", 9, "Service & Reklamationen", "Service-Eskalation auflösen"),
    ("ansprechpartner", 8, "Ansprechpartnerwechsel", "Beziehungsnetz neu aufbauen"),
    ("zahlung", 6, "Zahlungsverhalten", "Kaufmännisches Gespräch führen"),
    ("angebote", 5, "Angebotsaktivität", "Anfrageverhalten hinterfragen"),
    ("preis", 5, "Preisentwicklung", "Preisgespräch vorbereiten"),
    ("kommunikation", 3, "Kommunikationsintensität", "Kontaktfrequenz erhöhen"),
)


def severities() -> dict:
    """Each signal's severity from 0 to 1."""
    n = number
    change = growth(n("umsatz_ytd"), n("umsatz_vorjahr"))
    group = cleaned("wettbewerber_produktgruppe")
    rival = n("wettbewerber_aktiv").cast("int") != 0
    rise = F.when(n("service_faelle_vorjahr") > 0, n("service_faelle") / n("service_faelle_vorjahr")).when(n("service_faelle") > 3, 2.0).otherwise(1.0)
    return {
        "umsatz": clamp(-change / 30),
        "bestellfreq": clamp(-growth(n("bestellungen_ytd"), n("bestellungen_vorjahr")) / 40),
        "letzter_kauf": clamp((n("tage_seit_letztem_einkauf") - 30) / 70),
        "wettbewerb": F.when(rival & (group != ""), F.when(change < 0, 1.0).otherwise(0.6)).when(rival, 0.5).otherwise(0.0),
        "portfolio": clamp(F.greatest(F.lit(0.0), n("produkte_vorjahr") - n("produkte_aktuell")) / 3),
        "service": clamp(clamp((rise - 1.2) / 1.8) * 0.6 + clamp((n("reklamationen") - n("reklamationen_vorjahr")) / 5) * 0.4),
        "ansprechpartner": clamp(n("ansprechpartner_wechsel") / 3),
        "zahlung": clamp(clamp(n("zahlungsverzug_tage") / 45) * 0.6 + clamp(n("mahnungen") / 3) * 0.4),
        "angebote": clamp(-growth(n("angebote_ytd"), n("angebote_vorjahr")) / 50),
        "preis": clamp((n("preisanpassung_pct") - 3) / 6),
        "kommunikation": clamp(-growth(n("kontakte_ytd"), n("kontakte_vorjahr")) / 50),
    }


def said(*parts) -> Column:
    """Texts and columns in a row."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def texts() -> dict[str, tuple[Column, Column]]:
    """Each signal's value and sentence, as reports show them."""
    n = number
    change = lambda name, before="vorjahr", now="ytd": growth(n(f"{name}_{now}"), n(f"{name}_{before}"))
    percent = lambda x: said(signed(x), " %")
    revenue = change("umsatz")
    group = cleaned("wettbewerber_produktgruppe")
    rival = n("wettbewerber_aktiv").cast("int") != 0
    lost = F.greatest(F.lit(0.0), n("produkte_vorjahr") - n("produkte_aktuell"))
    days, late, dunned, moves, price = n("tage_seit_letztem_einkauf"), n("zahlungsverzug_tage"), n("mahnungen"), n("ansprechpartner_wechsel"), n("preisanpassung_pct")
    price_text = F.format_string("%.1f", even(price, 1))
    return {
        "umsatz": (percent(revenue), F.when(revenue < 0, said("Umsatz ", percent(revenue), " gegenüber Vorjahr (", grouped(n("umsatz_vorjahr") - n("umsatz_ytd")), " € Rückgang).")).otherwise(said("Umsatz ", percent(revenue), " gegenüber Vorjahr – stabil bis wachsend."))),
        "bestellfreq": (percent(change("bestellungen")), said(whole(n("bestellungen_ytd")), " Bestellungen im laufenden Jahr gegenüber ", whole(n("bestellungen_vorjahr")), " im Vorjahr.")),
        "letzter_kauf": (said(whole(days), " Tage"), said("Letzter Auftragseingang vor ", whole(days), " Tagen.")),
        "wettbewerb": (
            F.when(group != "", group).when(rival, "aktiv").otherwise("—"),
            F.when(rival & (group != ""), said("Wettbewerber gewinnt Anteile in der Produktgruppe „", group, "“.")).when(rival, "Wettbewerber im Account aktiv.").otherwise("Kein Wettbewerbsdruck erkennbar."),
        ),
        "portfolio": (said(whole(n("produkte_aktuell")), " von ", whole(n("produkte_vorjahr"))), F.when(lost > 0, said(whole(lost), " Produktgruppe(n) gegenüber Vorjahr abbestellt.")).otherwise("Portfolio unverändert oder ausgebaut.")),
        "service": (
            said(whole(n("service_faelle")), " / ", whole(n("reklamationen"))),
            said(whole(n("service_faelle")), " Servicefälle (Vorjahr ", whole(n("service_faelle_vorjahr")), "), ", whole(n("reklamationen")), " Reklamationen (Vorjahr ", whole(n("reklamationen_vorjahr")), ")."),
        ),
        "ansprechpartner": (whole(moves), F.when(moves > 0, said(whole(moves), " Wechsel auf Kundenseite – gewachsene Beziehungen gehen verloren.")).otherwise("Ansprechpartner stabil.")),
        "zahlung": (said(whole(late), " Tage"), F.when((late > 0) | (dunned > 0), said("Ø ", whole(late), " Tage Zahlungsverzug, ", whole(dunned), " Mahnung(en).")).otherwise("Zahlungsverhalten unauffällig.")),
        "angebote": (percent(change("angebote")), said(whole(n("angebote_ytd")), " Anfragen im laufenden Jahr gegenüber ", whole(n("angebote_vorjahr")), " im Vorjahr.")),
        "preis": (said("+", price_text, " %"), F.when(price > 3, said("Preise um ", price_text, " % angehoben – bei aktivem Wettbewerb ein Abwanderungsanlass.")).otherwise(said("Preisanpassung von ", price_text, " % im üblichen Rahmen."))),
        "kommunikation": (percent(change("kontakte")), said(whole(n("kontakte_ytd")), " Kundenkontakte gegenüber ", whole(n("kontakte_vorjahr")), " im Vorjahr.")),
    }


def scored(accounts: DataFrame) -> DataFrame:
    """accounts with signale (array by contribution), risiko, segment, dominant, aktion, frist, umsatz_risiko."""
    parts = severities()
    signals = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key"), F.lit(label).alias("label"), F.lit(w).alias("gewicht"), parts[k].alias("severity"), even(parts[k] * w, 2).alias("beitrag")) for i, (k, w, label, _) in enumerate(SIGNALS)])
    by_weight = F.array_sort("_signale", lambda a, b: F.when(a["beitrag"] > b["beitrag"], -1).when(a["beitrag"] < b["beitrag"], 1).otherwise(a["pos"] - b["pos"]))
    risk = clamp(F.aggregate("_signale", F.lit(0.0), lambda s, x: s + x["beitrag"]), 0.0, 100.0)
    group = cleaned("wettbewerber_produktgruppe")
    named = lambda text: F.replace(text, F.lit("{gruppe}"), F.when(group != "", group).otherwise(NO_GROUP))
    actions = F.create_map(*[F.lit(x) for k, _, _, action in SIGNALS for x in (k, action)])
    details = F.create_map(*[F.lit(x) for k, d in DETAILS.items() for x in (k, d)])
    out = accounts.withColumn("_signale", signals).withColumns({"_risiko": risk, "signale": by_weight}).drop("_signale")
    return out.withColumns(
        {
            "risiko": even(F.col("_risiko")),
            "segment": tier(F.col("_risiko"), (65, "Kritisch"), (40, "Gefährdet"), (25, "Beobachten"), other="Stabil"),
            "dominant": F.col("signale")[0]["key"],
            "aktion": named(actions[F.col("signale")[0]["key"]]),
            "detail": named(details[F.col("signale")[0]["key"]]),
            "frist": tier(F.col("_risiko"), (65, "innerhalb 48 h"), (40, "diese Woche"), other="in 2 Wochen"),
            "umsatz_risiko": even(number("umsatz_ytd") * F.col("_risiko") / 100),
        }
    ).drop("_risiko")


def signals(scores: DataFrame, least: float = 0.25) -> DataFrame:
    """A row for each signal of at least that severity."""
    return scores.select("kunde_id", F.explode(F.filter("signale", lambda s: s["severity"] >= least)).alias("s")).select("kunde_id", "s.key", "s.gewicht", even(F.col("s.severity"), 3).alias("severity"), "s.beitrag")


def sentences(accounts: DataFrame) -> DataFrame:
    """A row for each signal of an account: its value and sentence."""
    rows = F.array(*[F.struct(F.lit(k).alias("key"), wert.alias("wert"), text.alias("text")) for k, (wert, text) in texts().items()])
    return accounts.select("kunde_id", F.explode(rows).alias("s")).select("kunde_id", "s.*")


def by_risk(scores: DataFrame, n: int) -> DataFrame:
    """The n accounts of most revenue at risk with their rank."""
    from pyspark.sql import Window

    order = (F.desc("umsatz_risiko"), F.col("kunde_id"))
    return scores.orderBy(*order).limit(n).withColumn("rang", F.row_number().over(Window.orderBy(*order)))


def causes(scores: DataFrame) -> DataFrame:
    """Dominant causes with their accounts and revenue at risk, greatest first."""
    return scores.groupBy("dominant").agg(F.count("*").alias("n"), F.sum("umsatz_risiko").alias("umsatz_risiko")).orderBy(F.desc("umsatz_risiko"), "dominant")


def kpis(scores: DataFrame) -> DataFrame:
    total, at_risk = F.sum(number("umsatz_ytd").cast("decimal(28,4)")).cast("double"), F.coalesce(F.sum("umsatz_risiko"), F.lit(0.0))
    return scores.agg(
        F.count("*").alias("kunden"),
        F.count_if(F.col("segment") == "Kritisch").alias("kritisch"),
        F.count_if(F.col("segment") == "Gefährdet").alias("gefaehrdet"),
        F.count_if(F.col("segment") == "Beobachten").alias("beobachten"),
        at_risk.alias("umsatz_risiko"),
        even(F.avg("risiko"), 1).alias("avg_risiko"),
        F.when(total > 0, even(at_risk / total * 100, 1)).otherwise(0.0).alias("risiko_quote_pct"),
    )
