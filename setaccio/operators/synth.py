"""Synthetic requests: templates and pools indexed by a hash of the row number, so that any row can be made anywhere, again and alike."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from setaccio.operators.dedup import quota

#: Intents with two templates each; a name in braces is a pool. Written for this library.
TEMPLATES = {
    "create_event": ("Fissa {title} con {contact} {date} alle {time}", "Vorrei mettere {title} in agenda {date} alle {time}"),
    "update_event": ("Porta {title} a {date} alle {time}", "Cambia il giorno di {title}: {date}"),
    "delete_event": ("Annulla {title} di {date}", "Leva {title} con {contact} dal calendario"),
    "create_recurring": ("Fissa {title} {every} alle {time}", "Metti {title} {every} con {contact}"),
    "delete_recurring": ("Interrompi {title} {every}", "Basta con {title} {every} alle {time}"),
    "query_schedule": ("Cosa ho {date}?", "Che impegni ci sono {date} alle {time}?"),
    "find_free_slot": ("Quando sono libero {date}?", "Trovami un buco {date} per {title}"),
    "add_reminder": ("Fammi ricordare {title} {date}", "Un promemoria per {title} {date} alle {time}"),
    "update_reminder": ("Il promemoria di {title} va a {date}", "Cambia il promemoria di {title} alle {time}"),
    "delete_reminder": ("Togli il promemoria di {title} delle {time}", "Via il promemoria {date} di {title}"),
    "add_contact": ("Salva {contact}, {role}, {phone}", "Nuovo contatto: {contact}, posta {mail}"),
    "query_contact": ("Qual è il numero di {contact}?", "Dammi la posta di {contact}, {role}"),
    "update_contact": ("Il nuovo numero di {contact} è {phone}", "Cambia la posta di {contact} in {mail}"),
    "delete_contact": ("Elimina {contact} dai contatti", "Non mi serve più {contact}, {role}"),
    "add_birthday": ("{contact} compie gli anni {date}", "Segna il compleanno di {contact}: {date}"),
    "query_birthday": ("Quando compie gli anni {contact}?", "Chi compie gli anni {date}?"),
    "query_datetime": ("Che giorno è {date}?", "Che giorno della settimana cade {date}?"),
    "query_duration": ("Quanto manca a {date}?", "Quanti giorni mancano a {title} {date}?"),
    "query_holiday": ("È festa {date}?", "Quale festa cade {date}?"),
    "set_status": ("Segnami come occupato {date}", "Non disturbare {date} alle {time}"),
    "unknown": ("Raccontami di {title} e di {contact}", "Che cosa pensa {contact} di {title}?"),
}
#: The six intents of the smaller set and how many of each are wanted.
FIRST_SET = {"create_event": 175, "delete_event": 175, "query_schedule": 180, "add_reminder": 175, "add_contact": 175, "unknown": 180}
#: Wanted of each intent of the larger set, and attempts for each one wanted.
WANTED, ATTEMPTS = 200, 60
#: Characters of a prompt by which two of an intent count as the same.
PREFIX = {1: 50, 2: 60}
_FIRST = ("Ada", "Bruno", "Carla", "Dario", "Elsa", "Fabio", "Gina", "Ivo", "Lia", "Mario", "Nora", "Pia", "Ugo")
_LAST = ("Neri", "Conti", "Riva", "Sala", "Monti", "Galli", "Serra", "Bassi", "Fonti", "Villa", "Costa", "Gatti", "Leoni")
_DAYS = ("lunedì", "martedì", "mercoledì", "giovedì", "venerdì")
_MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")
POOLS = {
    "title": ("la riunione", "il corso di nuoto", "la visita medica", "il pranzo", "la lezione di piano", "il colloquio", "la consegna", "la revisione", "il concerto", "la spesa", "il torneo", "la cena"),
    "contact": tuple(f"{first} {last}" for first in _FIRST for last in _LAST),
    "date": ("domani", "dopodomani", *(f"{day} prossimo" for day in _DAYS), *(f"il {d} {month}" for month in _MONTHS for d in range(1, 29))),
    "time": tuple(f"{h}:{m:02d}" for h in range(7, 22) for m in range(0, 60, 5)),
    "every": ("ogni giorno", "ogni mese", *(f"ogni {day}" for day in _DAYS), *(f"ogni {n} {unit}" for unit in ("giorni", "settimane") for n in range(2, 16))),
    "role": ("collega", "idraulico", "cliente", "vicino", "dentista", "fornitore"),
}


def pick(pool: tuple[str, ...], seq: Column, seed: int, name: str) -> Column:
    """One of a pool's values for each row number."""
    return F.element_at(F.array(*map(F.lit, pool)), (F.pmod(F.xxhash64(seq, F.lit(seed), F.lit(name)), F.lit(len(pool))) + 1).cast("int"))


def phone(seq: Column, seed: int) -> Column:
    """Three digits from 320, a hyphen, and seven digits."""
    h = F.xxhash64(seq, F.lit(seed), F.lit("phone"))
    return F.format_string("%03d-%07d", F.pmod(h, F.lit(80)) + 320, F.pmod(F.shiftright(h, 8), F.lit(10_000_000)))


def mail(contact: Column, seq: Column, seed: int) -> Column:
    """A contact's name with a number, at an invented domain."""
    return F.concat(F.replace(F.lower(contact), F.lit(" "), F.lit(".")), F.pmod(F.xxhash64(seq, F.lit(seed), F.lit("mail")), F.lit(1000)).cast("string"), F.lit("@posta.example"))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A template with each name in braces replaced by its value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def round_robin(pool: tuple[str, ...], seq: Column) -> Column:
    """The pool's values in turn."""
    return F.element_at(F.array(*map(F.lit, pool)), (F.pmod(seq, F.lit(len(pool))) + 1).cast("int"))


def requests(spark: SparkSession, wanted: dict[str, int], version: int = 2, seed: int = 42) -> DataFrame:
    """intent, seq, prompt, completion: for each intent as many prompts of distinct beginnings as wanted, or as attempts have given.

    Slots of a completion are those its prompt names, and the intent.
    """
    intents = [F.struct(F.lit(i).alias("intent"), F.lit(n).alias("wanted"), F.array(*map(F.lit, TEMPLATES[i])).alias("templates")) for i, n in wanted.items()]
    rows = spark.range(1).select(F.inline(F.array(*intents))).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("wanted") * ATTEMPTS - 1).cast("long"))))
    key = F.xxhash64("intent", "seq")
    values = {name: pick(pool, key, seed, name) for name, pool in POOLS.items()}
    values |= {"phone": phone(key, seed), "mail": mail(values["contact"], key, seed)}
    template = F.element_at("templates", (F.pmod(F.col("seq"), F.size("templates")) + 1).cast("int"))
    rows = rows.withColumn("template", template)
    named = F.struct(F.col("intent"), *(F.when(F.contains("template", F.lit("{" + n + "}")), v).alias(n) for n, v in values.items()))
    made = rows.select("intent", "wanted", "seq", fill(F.col("template"), values).alias("prompt"), F.to_json(named).alias("completion"))
    kept = quota(made, "intent", "prompt", "seq", PREFIX[version], max(wanted.values()))
    return kept.where(F.col("rank") <= F.col("wanted")).select("intent", "seq", "prompt", "completion")


def first_requests(spark: SparkSession) -> DataFrame:
    """The smaller set of six intents."""
    return requests(spark, FIRST_SET, 1)


def all_requests(spark: SparkSession) -> DataFrame:
    """The larger set: every intent and `unknown`."""
    return requests(spark, dict.fromkeys(TEMPLATES, WANTED), 2)


def shortfall(found: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """intent, n, missing: how many of each intent were wanted and not made."""
    want = found.sparkSession.createDataFrame(sorted(wanted.items()), "intent string, wanted int")
    counts = found.groupBy("intent").agg(F.count(F.lit(1)).alias("n"))
    return want.join(counts, "intent", "left").select("intent", F.coalesce("n", F.lit(0)).alias("n"), (F.col("wanted") - F.coalesce("n", F.lit(0))).alias("missing"))


#: The smallest set: for each intent the beginnings and the ends of its prompts, each end with its slots; every beginning goes with every end.
STATIC = {
    "create_event": (("Metti", "Segna", "Aggiungi", "Inserisci", "Fissami"), (
        ("il dentista mercoledì alle 10", {"title": "dentista", "date": "mercoledì", "time": "10:00"}), ("un colloquio con Ada Neri e Ivo Bassi domani", {"title": "colloquio", "contact": ["Ada Neri", "Ivo Bassi"], "date": "domani"}),
        ("la cena di classe sabato", {"title": "cena di classe", "date": "sabato"}), ("il tagliando dell'auto il 4 maggio", {"title": "tagliando dell'auto", "date": "4 maggio"}), ("una lezione alle 18", {"title": "lezione", "time": "18:00"}))),
    "delete_event": (("Togli", "Annulla", "Cancella", "Elimina", "Leva"), (
        ("la cena di sabato", {"title": "cena", "date": "sabato"}), ("tutto venerdì", {"date": "venerdì", "scope": "all"}), ("il corso di nuoto", {"title": "corso di nuoto"}),
        ("la visita con Elsa Monti", {"title": "visita", "contact": "Elsa Monti"}), ("l'impegno delle 9", {"time": "09:00"}))),
    "query_schedule": (("Che faccio", "Ho impegni", "Cosa c'è in agenda", "Sono occupato"), (
        ("domani?", {"date": "domani"}), ("il 3 maggio?", {"date": "3 maggio"}), ("alle 15?", {"time": "15:00"}), ("questa sera?", {"date": "stasera"}), ("con Pia Gatti?", {"contact": "Pia Gatti"}))),
    "add_reminder": (("Ricordami", "Fammi venire in mente", "Promemoria:", "Avvisami per", "Non farmi scordare"), (
        ("il latte stasera", {"note": "latte", "date": "stasera"}), ("la bolletta lunedì", {"note": "bolletta", "date": "lunedì"}), ("le chiavi alle 8", {"note": "chiavi", "time": "08:00"}),
        ("il compito di Gina", {"note": "compito di Gina"}), ("l'abbonamento il 30", {"note": "abbonamento", "date": "30"}))),
    "add_contact": (("Salva", "Aggiungi", "Registra", "Memorizza", "Metti in rubrica"), (
        ("Lia Fonti, cliente", {"name": "Lia Fonti", "role": "cliente"}), ("Ugo Leoni 333-1234567", {"name": "Ugo Leoni", "phone": "333-1234567"}), ("Nora Costa, posta nora@posta.example", {"name": "Nora Costa", "email": "nora@posta.example"}),
        ("Dario Sala idraulico 340-7654321", {"name": "Dario Sala", "role": "idraulico", "phone": "340-7654321"}), ("Carla Riva", {"name": "Carla Riva"}))),
    "unknown": (("Quanto è alto", "Chi ha scalato per primo", "Raccontami", "Descrivi"), (
        ("il Cervino?", {}), ("il Monviso?", {}), ("il Gran Sasso?", {}), ("l'Etna?", {}), ("il Pelmo?", {}))),
}


def static_requests(spark: SparkSession) -> DataFrame:
    """prompt, completion of the smallest set."""
    pairs = [(f"{begin} {end}", json.dumps({"intent": intent} | slots, ensure_ascii=False)) for intent, (begins, ends) in STATIC.items() for begin in begins for end, slots in ends]
    return spark.createDataFrame(pairs, "prompt string, completion string")
