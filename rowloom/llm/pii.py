"""Personal data: exact patterns, and a span classifier trained from weak labelers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import col, cut, let, running_sums, text_or_empty

# The kinds in order. The patterns below find what the plain patterns find, leftmost and without overlap:
# a match may start only where a run of its first class starts or where the last match ended (\G), and repeats don't
# give back, so that long runs cost linear time.
KINDS = ["email", "ip", "card", "phone"]
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Texts without a match of a kind's gate have no match of the kind.
GATES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}

# Gazetteers and cue words of the labelers.
TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "herr", "frau", "señor", "señora", "monsieur", "madame"]
FIRST_NAMES = [
    "alex", "alice", "ana", "andreas", "anna", "anne", "antonio", "carlos", "carmen", "charles", "christine", "claire", "daniel", "david", "elena",
    "elizabeth", "emma", "francisco", "hans", "helen", "henry", "isabel", "jack", "jacques", "james", "jane", "javier", "jean", "john", "jose", "juan",
    "julia", "karl", "kate", "klaus", "laura", "lucia", "luis", "manuel", "maria", "marie", "mark", "martin", "mary", "michael", "miguel", "nicolas",
    "olivia", "paul", "pedro", "peter", "pierre", "robert", "sarah", "sofia", "sophie", "susan", "thomas", "ursula", "william",
]
CUES = [
    "tel", "telephone", "phone", "mobile", "call", "fax", "cell", "contact", "whatsapp", "reach", "telefon", "teléfono", "téléphone", "handy", "móvil",
    "card", "visa", "mastercard", "account", "iban", "ssn", "passport", "licence", "licencia", "born", "dob", "patient", "customer", "tax", "konto",
    "cuenta", "compte", "follow", "dear", "signed", "regards",
]
SECRET_CUES = ["token", "key", "apikey", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials", "private", "access"]
COUNTER_CUES = [
    "version", "isbn", "issn", "price", "total", "page", "pages", "chapter", "order", "item", "figure", "table", "section", "date", "year", "build",
    "commit", "hash", "sha", "sha1", "sha256", "md5", "checksum", "digest", "revision", "model", "serial", "uuid", "doi", "volume", "usd", "eur",
]
#: Code points before a candidate in which cues are looked for.
CONTEXT = 24
#: A number has this many digits at least, a secret this many characters, of which one is a digit and one a letter.
LEAST_DIGITS, LEAST_SECRET = 7, 16
_PLAIN = "[A-Za-z0-9_+/-]"
NUMBER = rf"(?:(?<![A-Za-z0-9_])|\G)\(?[0-9](?:[\x20()./-]*+[0-9]){{{LEAST_DIGITS - 1},}}+(?![A-Za-z])"
HANDLE = r"(?:(?<![A-Za-z0-9_.@])|\G)@[A-Za-z0-9_]{3,}+"
TITLED = r"(?:(?<!\p{L})|\G)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Sir|Madame|Monsieur|Señora?)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?+"
SECRET = rf"(?<!{_PLAIN})(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z]){_PLAIN}{{{LEAST_SECRET},}}+"
CANDIDATE = f"{SECRET}|{NUMBER}|{HANDLE}|{TITLED}"
# a secret has a digit next to a letter or sign somewhere
CANDIDATE_GATE = (
    rf"[0-9](?:[\x20()./-]*+[0-9]){{{LEAST_DIGITS - 1}}}|@[A-Za-z0-9_]{{3}}|[0-9][A-Za-z_+/-]|[A-Za-z_+/-][0-9]"
    r"|[MDPHFS](?:rs?|s|iss|r|rof|err|rau|ir|adame|onsieur|eñora?)\.?\x20\p{Lu}"
)
MORE_KINDS = {"n": "number", "h": "handle", "p": "name", "s": "secret"}
LABELERS = ["shape", "length", "gazetteer", "context", "checksum", "variety"]
#: Characters of a candidate's features, after its votes: kind, digits, length, separators, capitals.
FEATURES = 5
ROUNDS = 50
STEPS = 600


def matches(text: Column, pattern: str, gate: str) -> Column:
    """array<struct<s, e, m>>: the matches of ``pattern`` with their places in code points, end exclusive.

    What stands between matches gives the places; texts without a match of ``gate`` are done at once."""

    def of(m: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
        lengths = F.transform(m, lambda x: F.length(x).cast("bigint"))

        def placed(gaps: Column) -> Column:
            steps = F.zip_with(F.slice(gaps, 1, F.size(m)), lengths, lambda a, b: a + b)
            starts = F.zip_with(running_sums(steps), F.slice(gaps, 1, F.size(m)), lambda a, b: a + b)
            return F.zip_with(starts, m, lambda a, b: F.struct(a.alias("s"), (a + F.length(b)).alias("e"), b.alias("m")))

        return let(between, placed)

    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")
    return F.when(text.rlike(gate), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    last = F.length(digits) - 1

    def value(_, i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((last - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(F.split(digits, ""), lambda x, i: F.coalesce(value(x, i), F.lit(0))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind that pass its test; a match that fails is dropped, and nothing in it is tried again."""
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|(?<=0))"
    ip_ok = rf"^{part}(?:\.{part}){{3}}$"
    tests = {
        "email": None,
        "ip": lambda m: m["m"].rlike(ip_ok),
        "card": lambda m: let(digits_of(m["m"]), lambda d: F.length(d).between(16, 19) & luhn(d)),
        "phone": lambda m: F.length(digits_of(m["m"])).between(8, 15),
    }
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    out = {}
    for kind in KINDS:
        found = matches(text, patterns[kind], GATES[kind])
        out[kind] = F.filter(found, tests[kind]) if tests[kind] else found
    return out


def mod_97(code: Column) -> Column:
    """Whether an IBAN passes its check: the first four characters moved to the end, letters as 10 to 35, modulo 97."""
    moved = F.upper(F.concat(F.substring(code, 5, 1 << 30), F.substring(code, 1, 4)))

    def add(a: Column, c: Column) -> Column:
        n = F.ascii(c) - 48
        return F.when(c == "", a).when(n <= 9, (a * 10 + n) % 97).otherwise((a * 100 + n - 7) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), add) == 1


def votes(match: Column, before: Column) -> Column:
    """The labelers' votes on a candidate and its features as one string: a character for each labeler, + for personal,
    - for not, 0 for no opinion; then a character for each feature."""
    m, low = match["m"], F.lower(before)

    def word_in(words: list[str], text: Column = low) -> Column:
        return text.rlike(r"(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})")

    def of(digits: Column) -> Column:
        n, size = F.length(digits), F.length(m)
        kind = F.when(m.startswith("@"), "h").when(m.rlike(r"^\p{Lu}\p{Ll}*\.?\x20"), "p").when(m.rlike("[A-Za-z]"), "s").otherwise("n")
        number, secret = kind == "n", kind == "s"
        phone = r"^\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^0[0-9]{2,4}[\x20/-][0-9]{5,}$"
        dated = r"^[0-9]{1,4}([./-])[0-9]{1,2}\1[0-9]{1,4}$|^[0-9]+\.[0-9]+\.[0-9.]+$|^97[89][0-9\x20-]{10,}$"
        shape = (
            F.when(number, F.when(m.rlike(dated), "-").when(m.rlike(phone), "+").otherwise("0"))
            .when(secret, F.when(m.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-"), "-").when(m.rlike(r"^(?:[0-9a-f]{32,}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,}|[A-Za-z]{2,6}[_-].*)$"), "+").otherwise("0"))
            .otherwise("+")
        )
        length = (
            F.when(number, F.when(n.between(9, 11) | (n == 16), "+").when((n < 9) | (n > 19), "-").otherwise("0"))
            .when(secret, F.when(size >= 20, "+").otherwise("-"))
            .otherwise(F.when(size >= 5, "+").otherwise("0"))
        )
        gazetteer = F.when((kind == "p") | word_in(FIRST_NAMES, F.lower(F.regexp_replace(m, r"[0-9_@]+", " "))) | word_in(TITLES), "+").otherwise("0")
        cue = F.when(secret, word_in(SECRET_CUES) | word_in(["iban", "account", "konto"])).otherwise(word_in(CUES))
        context = F.when(word_in(COUNTER_CUES), "-").when(cue, "+").otherwise("0")
        checksum = F.when(number & n.between(13, 19), F.when(luhn(digits), "+").otherwise("0")).when(
            secret & m.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), F.when(mod_97(m), "+").otherwise("-")
        ).otherwise("0")
        different = F.size(F.array_distinct(F.split(F.when(number, digits).otherwise(m), "")))
        few, many = F.when(secret, 8).otherwise(3), F.when(secret, 11).otherwise(4)
        variety = F.when(different < few, "-").when(different >= many, "+").otherwise("0")
        by_digits = F.when(n == 0, "0").when(n < 9, "1").when(n < 12, "2").when(n < 16, "3").when(n < 20, "4").otherwise("5")
        by_size = F.when(size < 10, "0").when(size < 16, "1").when(size < 24, "2").when(size < 48, "3").otherwise("4")
        between = F.length(F.regexp_replace(m, r"[^\x20()./_+-]+", ""))
        separators = F.when(between == 0, "0").when(between <= 2, "1").otherwise("2")
        capitals = F.when(m.rlike(r"\p{Lu}"), "1").otherwise("0")
        return F.concat(shape, length, gazetteer, context, checksum, variety, kind, by_digits, by_size, separators, capitals)

    return let(digits_of(m), of)


def fit(counts: dict[str, int]) -> dict[str, float]:
    """The probability that a candidate is personal, for each pattern of votes and features.

    Expectation-maximisation in the manner of Dawid and Skene estimates, for either class, how often each labeler
    says +, - and 0, from the votes alone. Then a logistic classifier of votes and span features is trained on the
    estimated labels, so that features tell apart what labelers have no opinion on. Both work on the counts of
    patterns, whose number is bounded by the labelers and features, so the driver's work doesn't grow with the corpus.
    The start leans against: with no votes either way a candidate isn't taken."""
    if not counts:
        return {}
    order = sorted(counts)
    m = len(LABELERS)
    n = np.array([counts[v] for v in order], np.float64)
    total = n.sum()
    says = np.array([["+-0".index(c) for c in v[:m]] for v in order])
    plus, minus = (says == 0).sum(axis=1), (says == 1).sum(axis=1)
    post = np.clip(0.35 + 0.2 * (plus - 2.0 * minus - 1), 0.05, 0.95)
    for _ in range(ROUNDS):
        logs = []
        for p in (1 - post, post):
            size = (n * p).sum()
            log = np.full(len(order), math.log((size + 1) / (total + 2)))
            for i in range(m):
                seen = np.bincount(says[:, i], weights=n * p, minlength=3) + 1.0
                log += np.log(seen / (size + 3))[says[:, i]]
            logs.append(log)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    said = [(i, c) for i in range(len(order[0])) for c in sorted({v[i] for v in order})]
    x = np.array([[1.0, *(float(v[i] == c) for i, c in said)] for v in order])
    weights = np.zeros(x.shape[1])
    share = n / total
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -60, 60)))
        weights -= 1.0 * (x.T @ ((p - post) * share) + 1e-4 * weights)
    p = 1 / (1 + np.exp(-np.clip(x @ weights, -60, 60)))
    return dict(zip(order, p.tolist(), strict=True))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, more) for each row of ``docs``: base is a struct of the spans of each kind, more the spans that the
    classifier adds, which touch no base span. Spans are struct<s, e>: code points from s to e (exclusive); those in
    more have their kind too (number, handle, name, secret).

    Candidates (numbers of LEAST_DIGITS digits or more, handles, names after a title, runs of LEAST_SECRET or more
    letters and digits) get votes by shape, length, gazetteer, context, checksum and variety. The reliabilities and
    the classifier are estimated from all candidates of all documents, as counts of patterns (see ``fit``);
    candidates of probability over a half are taken. What is written on the way are places, never the data found.

    Null texts count as empty, and have no spans. Null ids and repeated rows stay rows; texts are searched whole;
    with no candidates there's no classifier. An empty table gives an empty table; other columns are ignored."""
    body = F.col("body")
    df = docs.select(col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    spans = base_spans(body)

    def place(x: Column) -> Column:
        return F.struct(x["s"].alias("s"), x["e"].alias("e"))

    df = df.withColumns({k: F.transform(v, place) for k, v in spans.items()}).withColumn("candidates", matches(body, CANDIDATE, CANDIDATE_GATE))

    def apart(c: Column) -> Column:
        hit = F.lit(False)
        for k in KINDS:
            hit = hit | F.exists(F.col(k), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
        return ~hit

    def voted(c: Column) -> Column:
        at = F.greatest(c["s"] - CONTEXT, F.lit(0))
        before = F.substring(body, (at + 1).cast("int"), (c["s"] - at).cast("int"))
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), votes(c, before).alias("v"))

    df = df.withColumn("candidates", F.transform(F.filter("candidates", apart), voted))
    found = cut(df.select("id", *KINDS, "candidates"), "spans")
    patterns = found.select(F.explode("candidates.v").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    # at most the votes' combinations (3 ** 6) times the features' (4 * 6 * 5 * 3 * 2), whatever the corpus
    chance = fit({r["v"]: r["n"] for r in patterns.collect()})
    taken = sorted(v for v, p in chance.items() if p > 0.5)
    more = F.filter("candidates", lambda c: c["v"].isin(taken) if taken else F.lit(False))
    kind = F.create_map(*[F.lit(x) for kv in MORE_KINDS.items() for x in kv])
    return found.select(
        F.col("id").alias(id_col),
        F.struct(*KINDS).alias("base"),
        F.transform(
            more, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), kind[F.substring(c["v"], len(LABELERS) + 1, 1)].alias("kind"))
        ).alias("more"),
    )


def listed(kind: str | None, spans: Column) -> Column:
    """["kind:start:end", ...] of spans, which have their own kinds if none is given."""

    def one(x: Column) -> Column:
        name = x["kind"] if kind is None else F.lit(kind)
        return F.concat_ws(":", name, x["s"].cast("string"), x["e"].cast("string"))

    return F.transform(spans, one)
