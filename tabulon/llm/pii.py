"""Personal data by weak supervision, with built-in functions only.

Certain spans come from four patterns with checks (digits of an address, Luhn,
numbers of digits) and always stay. Doubtful spans - obfuscated addresses, national
phone numbers, other long numbers, keys and tokens - are candidates on which labelers
vote: patterns and checks, gazetteers (top-level domains, card issuers, trunk prefixes, key
prefixes), the words before the span, and the way it is written. Expectation-maximisation
over the counts of vote combinations of the whole corpus estimates how reliable each
labeler is, and the resulting probabilities train a logistic classifier over the votes and
the span's shape, which then decides on every candidate.

Only counts of vote and shape combinations reach the driver: at most
``3 ** labelers * shapes`` rows, whatever the input.

Defined results: null or empty text has no spans; spans are counted in code points;
ties do not arise, as candidates of one kind do not overlap certain spans of any kind
and the leftmost candidate wins; repeated rows give equal results; an empty table gives
an empty result; ``redact`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone")
#: All kinds: the last has no certain spans.
NAMES = (*KINDS, "secret")

# Written so that a failed try at the head of a run is not repeated inside the run, and
# with possessive groups only, which Java matches in a loop: time stays linear and the
# stack flat on long texts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20\x2D]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9\x2D]+[0-9]"

#: Doubtful spans, by kind. They must hold no line break and start at a word's head.
CANDIDATES = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}+ ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z]{2,24}+(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}+(?![0-9A-Za-z-]|[ -][0-9])",
    "phone": r"(?<![0-9A-Za-z.+(-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ .-][0-9]{3,4}[ .-][0-9]{3,6}(?![0-9A-Za-z.-])",
    "secret": r"(?<![0-9A-Za-z_/+.-])[0-9A-Za-z_/+-]{16,200}+(?![0-9A-Za-z_/+-])",
}
#: What a text with a candidate has in any case: a cheap test first.
SIGNS = {"email": r"(?i)[\[( ]at[\]) ]", "card": "[0-9](?:[ -]?[0-9]){12}", "phone": "[0-9]{2}[)]?[ .-][0-9]{3}", "secret": "[0-9A-Za-z_/+-]{16}"}
#: Gazetteers: frequent top-level domains; first digits of card issuers; trunk prefixes.
KEYS = "^(?:sk|pk|rk|ghp|gho|xox[abp]|akia|asia|aiza|eyj|glpat)"
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "kontakt", "correo", "courriel", "write", "address"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "kreditkarte", "carte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "tel.", "telephone", "telefon", "call", "mobile", "fax", "handy", "teléfono", "téléphone", "appelez", "llame"),
    "secret": ("token", "secret", "password", "passwort", "passwd", "pwd", "key", "apikey", "api_key", "bearer", "auth", "authorization", "credential", "clave", "contraseña"),
}
COUNTER_CUES = ("order", "invoice", "isbn", "version", "no.", "nr.", "id", "serial", "ref", "page", "art.")

#: Labelers, each 1 for, -1 against, 0 silent.
LABELERS = ("shape", "gazetteer", "context", "form")
ROUNDS, STEPS = 50, 300
#: Kinds that have candidates.
CHOSEN = tuple(NAMES.index(k) for k in CANDIDATES)


def find(text: Column, pattern: str) -> Column:
    """Array of (s, e, v): start, end and text of each leftmost match that overlaps no earlier one."""

    def places(gaps: Column, hits: Column) -> Column:
        step = F.aggregate(
            F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h"))),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out")),
            lambda a, x: F.when(x["h"].isNull(), a).otherwise(
                F.struct((a["at"] + x["g"] + F.length(x["h"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + F.length(x["h"])).alias("e"), x["h"].alias("v")))).alias("out"))
            ),
        )
        return step["out"]

    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return let(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(places(F.split(text, pattern, -1), h)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, twice).otherwise(n)

    each = F.transform(F.array_remove(F.split(F.reverse(number), ""), ""), value)
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def certain(text: Column) -> Column:
    """Array of (k, s, e, v) of the base spans: k counts in the order of ``KINDS``, starts ascend in each."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    n = lambda x: F.length(digits(x["v"]))
    tests = (
        ("@", EMAIL, lambda x: F.lit(True)),
        (".", IP, lambda x: x["v"].rlike(rf"^{part}\.{part}\.{part}\.{part}$")),
        (None, CARD, lambda x: n(x).between(16, 19) & luhn(digits(x["v"]))),
        ("+", PHONE, lambda x: n(x).between(8, 15)),
    )
    none = F.array().cast("array<struct<k:int,s:int,e:int,v:string>>")
    parts = []
    for k, (sign, pattern, test) in enumerate(tests):
        spans = _kind(F.filter(find(text, pattern), test), k)
        has = F.contains(text, F.lit(sign)) if sign else F.lit(True)
        parts.append(F.when(has & (F.lit(True) if k == 0 else text.rlike("[0-9]")), spans).otherwise(none))
    return F.concat(*parts)


def _kind(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))


def doubtful(text: Column, base: Column) -> Column:
    """Array of candidates that overlap neither a base span nor an earlier candidate."""
    none = F.array().cast("array<struct<k:int,s:int,e:int,v:string>>")
    mixed = lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]")
    spans_of = {kind: find(text, pattern) for kind, pattern in CANDIDATES.items()}
    spans_of["secret"] = F.filter(spans_of["secret"], mixed)
    found = F.concat(*[F.when(text.rlike(SIGNS[kind]), _kind(spans, NAMES.index(kind))).otherwise(none) for kind, spans in spans_of.items()])

    def apart(b: Column) -> Column:
        free = F.filter(found, lambda x: ~F.exists(b, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
        # candidates of different kinds may meet: the first in the order of kinds stays
        return let(free, lambda f: F.filter(f, lambda x: ~F.exists(f, lambda y: (y["k"] < x["k"]) & (x["s"] < y["e"]) & (y["s"] < x["e"]))))

    return let(base, apart)


def votes(text: Column, span: Column) -> Column:
    """The span's struct with each labeler's vote and a shape feature."""
    kind, value = span["k"], span["v"]
    before = F.lower(F.substring(text, F.greatest(span["s"] - 39, F.lit(1)), F.least(span["s"], F.lit(40))))
    tail = F.array_remove(F.split(before, r"[\s:,;()]+"), "")
    last = let(tail, lambda t: F.when(F.size(t) > 3, F.slice(t, -3, 3)).otherwise(t))
    number = digits(value)
    size, hexes = F.length(value), value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    part = F.length(number) / size  # of the span that is digits
    shape = (
        F.when(kind == 4, F.when(hexes & (size >= 24), 1).when(part.between(0.1, 0.7) & value.rlike("[a-z]") & value.rlike("[A-Z]"), 1).otherwise(-1))
        .when(kind == 0, F.when(value.rlike(r"[\[(]"), 1).when(value.rlike("@"), 1).otherwise(-1))
        .when(kind == 2, F.when(F.length(number).between(13, 19) & luhn(number), 1).otherwise(-1))
        .otherwise(F.when(F.length(number).between(9, 12), 1).when(F.length(number) < 8, -1).otherwise(0))
    )
    ending = F.lower(F.regexp_extract(value, "([A-Za-z]+)$", 1))
    gazetteer = (
        F.when(kind == 4, F.when(F.lower(value).rlike(KEYS) | (hexes & size.isin(32, 40, 48, 64, 128)), 1).when(value.rlike("^[A-Z]*[a-z]*[-_/]"), -1).otherwise(0))
        .when(kind == 0, F.when(ending.isin(*DOMAINS), 1).otherwise(-1))
        .when(kind == 2, F.when(number.rlike("^(?:4|5[1-5]|3[47]|6011|65)"), 1).otherwise(-1))
        .otherwise(F.when(number.rlike("^0[1-9]") | value.rlike(r"^\("), 1).otherwise(0))
    )
    form = (
        F.when(kind == 4, F.when(before.rlike("[=:\"'`]\\s*$"), 1).otherwise(-1))
        .when(kind == 2, F.when(value.rlike("^[0-9]{4}(?:[ -][0-9]{4}){3}"), 1).when(value.rlike("^[0-9]+$"), 0).otherwise(-1))
        .when(kind == 3, F.when(value.rlike(r"^(?:\(|0)"), 1).when(value.rlike(r"\."), -1).otherwise(0))
        .otherwise(F.when(value.rlike(r"[\[(]"), 1).otherwise(-1))
    )
    cue = F.lit(False)
    for name, cues in CUES.items():
        cue = F.when(kind == NAMES.index(name), _any(last, cues)).otherwise(cue)
    context = F.when(cue, 1).when(_any(last, COUNTER_CUES), -1).otherwise(0)
    return F.struct(kind.alias("k"), span["s"].alias("s"), span["e"].alias("e"), shape.alias("shape"), gazetteer.alias("gazetteer"), context.alias("context"), form.alias("form"), F.length(value).between(9, 40).cast("int").alias("middling"))


def _any(tokens: Column, listed: tuple) -> Column:
    return F.coalesce(F.exists(tokens, lambda w: w.isin(*listed)), F.lit(False))


def estimate(patterns: list[tuple]) -> dict:
    """(k, votes...) -> probability that such a candidate is personal data.

    ``patterns``: (k, votes..., n) rows. Expectation-maximisation of a
    two-class model in which labelers err independently; silence tells nothing."""
    out = {}
    for kind in sorted({p[0] for p in patterns}):
        rows = [(p[1:-1], p[-1]) for p in patterns if p[0] == kind]
        prior, right = 0.3, [0.9, *[0.75] * (len(rows[0][0]) - 1)]
        post = {}
        for _ in range(ROUNDS):
            for v, _n in rows:
                odds = math.log(prior / (1 - prior)) + sum(x * math.log(a / (1 - a)) for x, a in zip(v, right, strict=True))
                post[v] = 1 / (1 + math.exp(-odds))
            total = sum(n for _, n in rows)
            prior = min(0.95, max(0.05, (sum(post[v] * n for v, n in rows) + 1) / (total + 2)))
            for i in range(len(right)):
                spoke = sum(n for v, n in rows if v[i])
                agree = sum(n * (post[v] if v[i] > 0 else 1 - post[v]) for v, n in rows if v[i])
                right[i] = min(0.99, max(0.55, (agree + 4) / (spoke + 5)))  # better than chance, as a prior of 4 in 5 says
        out |= {(kind, *v): p for v, p in post.items()}
    return out


def train(patterns: list[tuple], prob: dict) -> list[float]:
    """Weights of a logistic classifier over (1, kinds, votes, middling), fitted to
    expected labels by gradient steps. ``patterns``: (k, votes..., middling, n)."""
    feats = [([1.0, *[float(p[0] == k) for k in CHOSEN], *map(float, p[1:-1])], prob[p[:-2]], p[-1]) for p in patterns]
    total = sum(f[2] for f in feats) or 1
    w = [0.0] * (len(feats[0][0]) if feats else 2 + len(CHOSEN) + len(LABELERS))
    for _ in range(STEPS):
        grad = [0.0] * len(w)
        for x, y, n in feats:
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, b in enumerate(x):
                grad[i] += n / total * (p - y) * b
        w = [a - 1.0 * (g + 1e-3 * a) for a, g in zip(w, grad, strict=True)]
    return w


def _candidates(text: Column, base: Column) -> Column:
    return F.transform(doubtful(text, base), lambda x: votes(text, x))


def classifier(df: DataFrame, text_col: str = "text") -> list[float]:
    """Weights from all texts of ``df``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    seen = df.select(text.alias("t")).where(F.col("t").rlike(r"[0-9]|(?i)[\[( ]at[\]) ]")).select(F.explode(F.array(_candidates(F.col("t"), certain(F.col("t"))))).alias("all")).select(F.explode("all").alias("c"))
    keys = ["k", *LABELERS, "middling"]
    # at most 4 * 3^4 * 2 rows: the combinations of votes
    rows = [tuple(r) for r in seen.select("c.*").groupBy(*keys).agg(F.count("*").alias("n")).collect()]
    merged: dict = {}
    for r in rows:
        merged[r[:-2]] = merged.get(r[:-2], 0) + r[-1]
    return train(sorted(rows), estimate([(*k, n) for k, n in sorted(merged.items())]))


def spans(text: Column, weights: list[float]) -> Column:
    """Struct of ``base`` and ``added`` arrays of (k, s, e); ``text`` must not be null."""
    bare = lambda a: F.transform(a, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    def accepted(x: Column) -> Column:
        values = [F.lit(1.0), *[(x["k"] == k).cast("double") for k in CHOSEN], *[x[n].cast("double") for n in (*LABELERS, "middling")]]
        score = F.lit(0.0)
        for a, v in zip(weights, values, strict=True):
            score = score + F.lit(float(a)) * v
        return score > 0

    empty = F.array().cast("array<struct<k:int,s:int,e:int>>")
    worth = text.rlike(r"[0-9@]|(?i)[\[( ]at[\]) ]")
    both = let(certain(text), lambda b: F.struct(bare(b).alias("base"), bare(F.filter(_candidates(text, b), accepted)).alias("added")))
    return F.when(worth, both).otherwise(F.struct(empty.alias("base"), empty.alias("added")))


def listing(found: Column) -> Column:
    """kind:start:end of each span, by kind, then start, joined by commas."""
    name = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(F.sort_array(found), lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def detect(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, ``base`` and ``added`` spans."""
    weights = classifier(df, text_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias(id_col), F.explode(F.array(spans(text, weights))).alias("found")).select(id_col, "found.*")


def redact(df: DataFrame, *, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """``df`` with each span of each text replaced by its kind in capitals in angle
    brackets. Of overlapping spans of different kinds, one tag stands for the first."""
    weights = classifier(df, text_col)
    text = F.col(f"`{text_col}`")

    def cut(found: Column) -> Column:
        name = F.array(*[F.lit(f"<{k.upper()}>") for k in NAMES])
        ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
        done = F.aggregate(
            ordered,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda a, x: F.when(x["s"] < a["at"], F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.get(name, x["k"])).alias("out"))),
        )
        return let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))

    both = let(spans(text, weights), lambda x: F.concat(x["base"], x["added"]))
    clean = F.when(text.isNull(), text).otherwise(let(both, lambda f: F.when(F.size(f) == 0, text).otherwise(cut(f))))
    out = df.withColumn(text_col, F.explode(F.array(clean)))
    if count_col and count_col in df.columns:
        out = out.withColumn(count_col, F.when(text.isNull(), F.col(f"`{count_col}`")).otherwise(F.length(text)).cast(df.schema[count_col].dataType))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.size(_of(F.col("base"), i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(F.concat("base", "added")).alias("spans"))


def _of(found: Column, k: int) -> Column:
    return F.filter(found, lambda x: x["k"] == k)
