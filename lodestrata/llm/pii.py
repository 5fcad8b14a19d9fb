r"""Personal data by weak supervision.

Base spans come from four strict rules (email, ip, card, phone). Candidates are what a loose pattern finds:
number groups, handles and titled names. Four labelers vote yes, no or nothing on each candidate: a strict-shape
regex, a gazetteer (titles, country codes, units of measure), the words before it, and its grouping. The votes
are counted by vote pattern over all documents (at most 81 patterns), and expectation maximisation over these
counts estimates each labeler's reliability and each pattern's chance to be personal data. With these chances as soft
labels a naive-Bayes span classifier is trained on features of the span (kind, digits, separators, plus sign, place
in a line), again from counts of bounded number. Candidates that it gives 0.5 or more, and that touch no base span,
are added; base spans always stay.

Built-in functions only; the driver sees counts of patterns and features, never rows. Only the counts are
shuffled, pre-aggregated; documents stay where they are.

Defined results: a null text counts as empty and has no spans; null doc_ids and repeated rows are kept; an empty
table gives no rows (and an untrained classifier that adds nothing); other columns are ignored by ``find`` and
kept by ``redact``.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import table, text_or_empty
from lodestrata.llm.spans import digits, luhn, named, with_matches

KINDS = ("email", "ip", "card", "phone")
ADDED = ("number", "handle", "name")
#: Possessive forms of the base patterns. A run of characters is entered at its start or where a match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Titles before names, in several languages.
TITLES = (
    "Mr", "Mrs", "Ms", "Miss", "Mister", "Madam", "Sir", "Lady", "Dr", "Doctor", "Prof", "Professor", "Rev", "Capt", "Col", "Sgt",
    "Herr", "Herrn", "Frau", "Fräulein", "Fru", "Monsieur", "Madame", "Mademoiselle", "Mme", "Mlle", "Maître",
    "Sr", "Sra", "Srta", "Señor", "Señora", "Señorita", "Don", "Doña", "Dott", "Sig", "Signor", "Signora", "Pan", "Pani", "Senhor", "Senhora",
)
#: A capitalised word of any language, to its end.
NAME = r"\p{Lu}(?=[\p{L}\p{M}'’])[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++)*+"
CANDIDATE = (
    r"(?<![0-9A-Za-z+])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}+(?![0-9A-Za-z])"
    r"|(?<![A-Za-z0-9_@.])@[A-Za-z][A-Za-z0-9_]{2,30}+(?![A-Za-z0-9_@])"
    rf"|(?<![\p{{L}}\p{{M}}])(?:{'|'.join(TITLES)})\.?\x20{NAME}(?:\x20{NAME})*+"
)
#: Words that stand before personal data or before other numbers, in several languages, each as a whole word.
FOR = (
    "phone", "mobile", "tel", "telephone", "cell", "call", "fax", "whatsapp", "contact", "mail", "card", "account", "iban", "passport", "ssn", "name", "address", "born", "user", "reach",
    "telefon", "handy", "anrufen", "rufnummer", "konto", "ausweis", "adresse", "geboren", "nutzer", "téléphone", "portable", "appeler", "carte", "compte", "passeport", "nom", "né", "née",
    "teléfono", "móvil", "llamar", "tarjeta", "cuenta", "pasaporte", "nombre", "dirección", "nacido", "usuario",
)
AGAINST = (
    "page", "pages", "version", "isbn", "issn", "doi", "token", "commit", "sha", "line", "chapter", "section", "no", "nr", "id", "key", "order", "invoice", "serial", "part", "build", "port", "year",
    "seite", "kapitel", "zeile", "bestellung", "rechnung", "jahr", "chapitre", "ligne", "commande", "facture", "année", "página", "capítulo", "línea", "pedido", "factura", "año",
)
CUES_FOR = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(FOR)})[^\p{{L}}\p{{N}}]{{0,4}}$"
CUES_AGAINST = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(AGAINST)})[^\p{{L}}\p{{N}}]{{0,4}}$"
UNITS = r"(?i)^\x20?(?:kg|km|cm|mm|mb|gb|ms|px|eur|usd|percent|%|\$)"
COUNTRY = r"^\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-6]|8[0-9]|9[0-9])"
#: Abstention, yes, no.
NOTHING, YES, NO = 0, 1, 2
ROUNDS = 50


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a column of spans for each base kind."""
    df = with_matches(df, "email", text, EMAIL, "@")
    df = with_matches(df, "ip", text, IP, ".")
    df = with_matches(df, "card", text, CARD)
    df = with_matches(df, "phone", text, PHONE, "+")
    significant = lambda part: F.regexp_replace(part, "^0+", "")
    small = lambda part: (F.length(significant(part)) <= 3) & (F.concat(F.lit("0"), significant(part)).try_cast("int") <= 255)
    df = df.withColumn("ip", F.filter("ip", lambda x: F.forall(F.split(x["m"], r"\."), small)))
    df = df.withColumn("card", F.filter("card", lambda x: F.length(digits(x["m"])).between(13, 19) & luhn(digits(x["m"]))))
    return df.withColumn("phone", F.filter("phone", lambda x: F.length(digits(x["m"])).between(9, 15)))


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``candidates``: spans with their votes (a number of four base-3 digits) and features."""
    df = with_matches(df, "candidates", text, CANDIDATE)

    def judged(x: Column) -> Column:
        m, d = x["m"], F.length(digits(x["m"]))
        first = F.greatest(x["s"] - 24, F.lit(0))
        before = F.substr(F.col(text), first + 1, x["s"] - first)
        after = F.substr(F.col(text), x["e"] + 1, F.lit(12))
        kind = F.when(F.startswith(m, F.lit("@")), 1).when(m.rlike(r"^[A-Z]"), 2).otherwise(0)
        number = kind == 0
        shape = F.when(number & F.startswith(m, F.lit("+")) & d.between(9, 15), YES).when(number & d.between(13, 19) & luhn(digits(m)), YES).when(number & m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), YES).when(number & (d > 15), NO).otherwise(NOTHING)
        gazetteer = F.when(kind == 2, YES).when(m.rlike(COUNTRY), YES).when(after.rlike(UNITS), NO).otherwise(NOTHING)
        context = F.when(before.rlike(CUES_FOR), YES).when(before.rlike(CUES_AGAINST), NO).otherwise(NOTHING)
        grouped = F.when(number & m.rlike(r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}$"), YES).when(number & m.rlike(r"^[0-9]+$") & ~d.between(9, 19), NO).when(number & m.rlike(r"[0-9][.][0-9]{1,2}$"), NO).otherwise(NOTHING)
        votes = shape + gazetteer * 3 + context * 9 + grouped * 27
        separators = F.when(m.rlike(r"[()]"), 3).when(F.contains(m, F.lit("-")), 2).when(F.contains(m, F.lit(" ")), 1).otherwise(0)
        line = F.when(before.rlike(r"(?:^|\n)$"), 1).otherwise(0)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), votes.alias("votes"), kind.alias("kind"), F.least(d, F.lit(20)).alias("digits"), separators.alias("separators"), F.startswith(m, F.lit("+")).cast("int").alias("plus"), line.alias("line"))

    return df.withColumn("candidates", F.transform("candidates", judged))


FEATURES = ("kind", "digits", "separators", "plus", "line")


def estimate(counts: dict[int, float]) -> tuple[dict[int, float], list[tuple[float, float]], float]:
    """Expectation maximisation over counts of vote patterns: each pattern's chance, each labeler's rates of
    yes among its votes on personal and other candidates, and the share of personal ones."""
    split = {p: [p // 3**i % 3 for i in range(4)] for p in counts}
    chance = {}
    for p, votes in split.items():
        yes, no = votes.count(YES), votes.count(NO)
        chance[p] = (yes + 0.5) / (yes + no + 1)
    rates, share = [(0.8, 0.2)] * 4, 0.5
    for _ in range(ROUNDS):
        total = sum(counts.values())
        share = min(0.95, max(0.05, sum(counts[p] * chance[p] for p in counts) / total)) if total else 0.5
        rates = []
        for i in range(4):
            own = []
            for weigh in (lambda p: chance[p], lambda p: 1 - chance[p]):
                yes = sum(counts[p] * weigh(p) for p in counts if split[p][i] == YES)
                all_ = sum(counts[p] * weigh(p) for p in counts if split[p][i] != NOTHING)
                own.append(yes + (0.8, 0.2)[len(own)] * 4)
                own[-1] /= all_ + 4
            rates.append((own[0], own[1]) if own[0] >= own[1] else (sum(own) / 2, sum(own) / 2))  # one worse than chance says nothing
        for p, votes in split.items():
            odds = math.log(share / (1 - share))
            for i, v in enumerate(votes):
                if v != NOTHING:
                    a, b = (min(0.99, max(0.01, x)) for x in rates[i])
                    odds += math.log(a / b) if v == YES else math.log((1 - a) / (1 - b))
            chance[p] = 1 / (1 + math.exp(-odds))
    return chance, rates, share


def train(docs: DataFrame, text: str = "text") -> dict[tuple[str, int], float]:
    """Log-odds of the span classifier, by feature and value; ("", 0) is the prior."""
    rows = with_candidates(docs.select(text_or_empty(text).alias("text"))).select(F.explode("candidates").alias("c"))
    counted = rows.groupBy("c.votes", *(f"c.{f}" for f in FEATURES)).agg(F.count("*").alias("n")).collect()  # bounded by the values of votes and features
    if not counted:
        return {}
    by_votes: dict[int, float] = defaultdict(float)
    for r in counted:
        by_votes[r["votes"]] += r["n"]
    chance, _, _ = estimate(dict(by_votes))
    sums: dict[tuple[str, int], list[float]] = defaultdict(lambda: [1.0, 1.0])
    for r in counted:
        p = chance[r["votes"]]
        for key in [("", 0), *((f, r[f]) for f in FEATURES)]:
            sums[key][0] += r["n"] * p
            sums[key][1] += r["n"] * (1 - p)
    a, b = sums[("", 0)]
    return {k: math.log(x / y) - (math.log(a / b) if k[0] else 0) for k, (x, y) in sums.items()}


def find(docs: DataFrame, model: dict | None = None, text: str = "text") -> DataFrame:
    """``docs`` with a span column for each base kind and ``added``, the classifier's further spans."""
    model = train(docs, text) if model is None else model
    rows = with_candidates(with_base(docs, text), text)
    base = F.concat(*(F.col(k) for k in KINDS))
    if not model:
        return rows.withColumn("added", F.filter("candidates", lambda x: F.lit(False))).drop("candidates")

    def score(x: Column) -> Column:
        out = F.lit(model[("", 0)])
        for f in FEATURES:
            w = F.lit(0.0)
            for (name, value), weight in sorted(model.items()):
                if name == f:
                    w = F.when(x[f] == value, weight).otherwise(w)
            out = out + w
        return out

    def fresh(x: Column) -> Column:
        return ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    return rows.withColumn("added", F.filter("candidates", lambda x: (score(x) >= 0) & fresh(x))).drop("candidates")


def _constant(value: str):
    return lambda x: F.lit(value)


def _is_kind(number: int):
    return lambda x: x["kind"] == number


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all columns, with each span of personal data in ``text`` replaced by its kind in brackets."""
    columns = docs.columns
    work = docs.select(F.struct(*columns).alias("_row"), text_or_empty(text).alias("text"), F.col(text).alias("_was"))
    found = find(work)
    label = lambda spans, kind: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), kind(x).alias("k")))
    names = F.array(*(F.lit(x.upper()) for x in ADDED))
    spans = F.array_sort(F.concat(*(label(F.col(k), _constant(k.upper())) for k in KINDS), label(F.col("added"), lambda x: F.get(names, x["kind"]))))
    found = found.withColumn("_spans", spans)

    def step(acc: Column, x: Column) -> Column:
        inside = x["s"] < acc["at"]  # overlaps what has been replaced
        gap = F.substr(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit("["), x["k"], F.lit("]"))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_spans", zero, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.length("text"))))
    found = found.withColumn("_clean", F.when(F.size("_spans") > 0, clean).otherwise(F.col("_was")))
    return found.select(*(F.col("_clean").alias(c) if c == text else F.col("_row")[c].alias(c) for c in columns))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = find(docs)
    base = F.concat(*(named(F.col(k), k) for k in KINDS))
    added = [named(F.filter("added", _is_kind(i)), k) for i, k in enumerate(ADDED)]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, *added), ",").alias("spans"))
