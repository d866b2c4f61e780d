"""Personal data by weak supervision, in DataFrame functions only.

Exact patterns give the base spans, which always stay. Looser patterns give further candidates, on which labelers
(format, checks, gazetteer, context) vote for, against or not at all. Expectation-maximisation over the counts of
the vote patterns estimates how reliable each labeler is; a logistic span classifier is then fitted to the soft
labels, and adds the candidates that it accepts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.text import running
from claimgraph.llm.common import let, whole

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. Written with character loops only: Java's matcher recurses in loops over groups. \x01 stands, one for
# one, for a character that ``marked`` has proven to be (card) or not to be (email) inside a match. A match that does not
# begin where a run of its first characters begins would fail as that run's beginning did, unless the run's beginning
# belongs to the match before; so (?<!...)|\G spares the matcher the square of a run's length.
EMAIL = r"(?:(?<![A-Za-z0-9._%+\x01-])|\G)[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]+\.[A-Za-z0-9-][A-Za-z0-9.-]*"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?=(?:\x01?[0-9]){16})[0-9][0-9\x01]*[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Looser candidates.
LOCAL_PHONE = r"(?<![0-9+()-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
SPELT_EMAIL = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63} ?[(\[]dot[)\]] ?[A-Za-z]{2,24}"
ID_NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PLAIN_CARD = r"(?<![0-9-])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}(?![0-9-])"

#: Words before a span that name its kind, in the corpus's languages; and signs of other uses of numbers.
GAZETTEER = {
    "email": r"e-?mail|mail|contact|write|reply|correo|escribe|courriel|[e\u00e9]cri|schreib|kontakt",
    "ip": r"\bip\b|host|server|address|login|dns|router|servidor|serveur|adresse|direcci[o\u00f3]n",
    "card": r"card|visa|mastercard|amex|credit|carte|karte|tarjeta|payment|iban|pago|paiement|zahlung",
    "phone": r"phone|\btel\b|call|mobile|cell|fax|contact|sms|whatsapp|anruf|ruf|appel|t[e\u00e9]l[e\u00e9]|m[o\u00f3]vil|llam",
    "id": r"ssn|social|passport|identity|ausweis|dni|nif|insee|tax|steuer|pasaporte|passeport",
}
AGAINST = r"(?:[#=/:_]|\bno\.|\bid|version|token|key|isbn|issn|order|invoice|page|sha|hash|part|serial|model)\s*$"


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


MATCHES = "array<struct<s:int,e:int,m:string>>"


def found(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: leftmost non-overlapping matches; s and e in code points from 0, e exclusive."""

    def place(parts: Column) -> Column:
        gaps, ms = parts["gaps"], parts["ms"]
        sizes = F.transform(ms, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def one(m: Column, i: Column, begins: Column) -> Column:
            s = F.get(begins, i) + F.length(F.get(gaps, i))
            return F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"))

        placed = let(running(sizes), lambda begins: F.transform(ms, lambda m, i: one(m, i, begins)))
        return F.when(F.size(ms) > 0, placed).otherwise(F.array().cast(MATCHES))

    return let(text, lambda t: let(F.struct(F.split(t, pattern).alias("gaps"), F.regexp_extract_all(t, F.lit(pattern), 0).alias("ms")), place))


#: Characters of a block. Spark counts the characters of a text from its start for each piece cut out of it; a piece cut
#: out of the blocks that it touches costs no more than those.
BLOCK = 256


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)


def piece(blocks: Column, start: Column, size: Column) -> Column:
    """The characters from ``start``, counted from 0, on."""
    k = F.floor(start / BLOCK).cast("int")
    near = F.slice(blocks, k + 1, F.floor((start + size) / BLOCK).cast("int") - k + 1)
    return F.substring(F.array_join(near, ""), start - k * BLOCK + 1, size)


def below(ordered: Column, value: Column) -> Column:
    """How many of an ascending array's values are less than ``value``, by halving."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.size(ordered))).cast("int"), F.lit(0)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    further = lambda at, step: F.when(F.get(ordered, at + step - 1) < value, at + step).otherwise(at)
    return F.when(F.size(ordered) > 0, F.aggregate(steps, F.lit(0), further)).otherwise(0)


def most_before(values: Column) -> Column:
    """For each of several values the largest before it, 0 for the first: maxima over blocks of the root of their number, and within a block."""
    side = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))

    def over(x: Column) -> Column:
        xs, b = x["xs"], x["b"]
        tops = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / b).cast("int")), lambda k: F.array_max(F.slice(xs, k * b + 1, b)))
        one = lambda i, held: F.greatest(F.array_max(F.slice(held, F.lit(1), F.floor(i / b).cast("int"))), F.array_max(F.slice(xs, i - i % b + 1, i % b)), F.lit(0))
        return let(tops, lambda held: F.transform(xs, lambda _, i: one(i, held)))

    return F.when(F.size(values) > 0, let(F.struct(values.alias("xs"), side.alias("b")), over)).otherwise(F.array().cast("array<int>"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits pass the Luhn check."""

    def value(i):
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def part_ok(part: Column) -> Column:
    return let(F.regexp_replace(part, "^0+", ""), lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def with_kind(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))


NONE = "array<struct<kind:string,s:int,e:int,m:string>>"


def none() -> Column:
    return F.array().cast(NONE)


def base_spans(text: Column) -> Column:
    """array<struct<kind, s, e, m>> by kind as listed, then start. Texts without a sign of a kind skip its pattern."""
    t = F.translate(text_of(text), "\x01", "\x02")
    email = with_kind("email", found(F.regexp_replace(t, r"\.(?![A-Za-z0-9-])", "\x01"), EMAIL))
    ip = with_kind("ip", F.filter(found(t, IP), lambda x: F.forall(F.split(x["m"], r"\."), part_ok)))
    card = with_kind("card", F.filter(found(F.regexp_replace(t, r"(?<=[0-9])[ -](?=[0-9])", "\x01"), CARD), lambda x: let(digits(x["m"]), lambda n: F.length(n).between(16, 19) & luhn(n))))
    phone = with_kind("phone", F.filter(found(t, PHONE), lambda x: F.length(digits(x["m"])).between(8, 15)))
    return F.concat(
        F.when(text.contains("@"), email).otherwise(none()),
        F.when(text.rlike(r"[0-9]\.[0-9]"), ip).otherwise(none()),
        F.when(text.rlike(r"(?:[0-9][ -]?){8}"), card).otherwise(none()),
        F.when(text.rlike(r"\+[0-9]"), phone).otherwise(none()),
    )


def loose_spans(text: Column) -> Column:
    """Candidates beyond the base: matches of the looser patterns and checked-out matches of the exact ones."""
    t = text_of(text)
    number = F.concat(with_kind("phone", found(t, LOCAL_PHONE)), with_kind("id", found(t, ID_NUMBER)), with_kind("card", found(t, PLAIN_CARD)))
    return F.concat(F.when(t.rlike(r"[0-9]{3}[)]?[ .-][0-9]{2}"), number).otherwise(none()), F.when(t.rlike(r"[(\[]at[)\]]"), with_kind("email", found(t, SPELT_EMAIL))).otherwise(none()))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others. Others of one kind are in order and apart, so of each kind the last that begins before a span's end tells."""
    of_kind = lambda k: F.filter(others, lambda y: y["kind"] == k)
    ends = F.array(*[let(of_kind(k), lambda ys: F.struct(ys["s"].alias("s"), ys["e"].alias("e"))) for k in KINDS])
    clear = lambda x, ys: F.coalesce(F.get(ys["e"], below(ys["s"], x["e"]) - 1) <= x["s"], F.lit(True))
    told = lambda xs: let(ends, lambda held: F.filter(xs, lambda x: F.forall(held, lambda ys: clear(x, ys))))
    return let(spans, lambda xs: F.when((F.size(xs) > 0) & (F.size(others) > 0), told(xs)).otherwise(xs))


LABELERS = ("check", "format", "gazetteer", "other", "company")


DESCRIBED = "array<struct<kind:string,s:int,e:int,pattern:string>>"


def described(text: Column, spans: Column, base: Column, is_base: bool) -> Column:
    """array<struct<kind, s, e, pattern>>; pattern: kind, votes of LABELERS (+ for, - against, 0 none), digits and separators.

    check: the digits' own check holds or fails. format: one separator throughout, or several. gazetteer: a word before
    the span names its kind, or only another one. other: what stands right before it speaks of another use. company: a
    base span is near.
    """

    def one(x: Column, blocks: Column, starts: Column) -> Column:
        before = F.lower(piece(blocks, F.greatest(x["s"] - 40, F.lit(0)), F.least(x["s"], F.lit(40))))
        n = F.length(digits(x["m"]))
        check = F.lit("+") if is_base else F.when(x["kind"] == "card", F.when(let(digits(x["m"]), luhn), "+").otherwise("-")).otherwise("0")
        form = F.when(x["m"].rlike(r"^[0-9]+$"), "0").when(F.size(F.array_distinct(F.split(F.regexp_replace(x["m"], r"[A-Za-z0-9()+@\[\]]", ""), ""))) <= 2, "+").otherwise("-")
        said = lambda v: before.rlike(f"(?:{v})[^.!?\n]*$")
        own = F.coalesce(*[F.when((x["kind"] == k) & said(v), "+") for k, v in GAZETTEER.items()])
        words = F.coalesce(own, F.when(said("|".join(GAZETTEER.values())), "-"), F.lit("0"))
        other = F.when(before.rlike(AGAINST), "-").otherwise("0")
        last, next_one = F.get(starts, below(starts, x["s"]) - 1), F.get(starts, below(starts, x["s"] + 1))
        company = F.when((x["s"] - last < 200) | (next_one - x["s"] < 200), "+").otherwise("0")
        shape = F.concat(F.least(n / 4, F.lit(5)).cast("int").cast("string"), F.when(x["m"].rlike(" "), "s").otherwise("_"), F.when(x["m"].rlike("-"), "d").otherwise("_"))
        return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.concat(x["kind"], F.lit("|"), check, form, words, other, company, F.lit("|"), shape).alias("pattern"))

    held = F.struct(blocks_of(text_of(text)).alias("blocks"), F.array_sort(base["s"]).alias("starts"))
    told = let(held, lambda h: F.transform(spans, lambda x: one(x, h["blocks"], h["starts"])))
    return F.when(F.size(spans) > 0, told).otherwise(F.array().cast(DESCRIBED))


def features(pattern: str) -> list[str]:
    """What the classifier sees of a pattern: its kind, its shape and each vote."""
    kind, votes, shape = pattern.split("|")
    return [f"kind {kind}", f"shape {shape}", *[f"{name} {vote}" for name, vote in zip(LABELERS, votes, strict=True)]]


@dataclass(frozen=True)
class SpanModel:
    #: (labeler, vote, class): the chance of the vote for private (1) and for other (0) spans.
    reliabilities: dict
    #: The share of private spans.
    prior: float
    #: The classifier: a weight for each feature, and the rest. Features that no span showed have none.
    weights: dict
    bias: float

    def odds(self, pattern: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(pattern))


def reliabilities(rows: list[tuple[str, int]], rounds: int = 50) -> tuple[dict, float, list[float]]:
    """Expectation-maximisation over (votes, count): the labelers' chances, the prior, and how likely each row is private.

    It starts from the labelers' plain majority; from then on only their estimated chances decide.
    """
    soft = [0.5 + 0.4 * (v.count("+") - v.count("-")) / max(1, len(v) - v.count("0")) for v, _ in rows]
    chance: dict = {}
    prior = 0.5
    for _ in range(rounds):
        chance = {}
        mass = [sum(n * (1 - q) for (_, n), q in zip(rows, soft, strict=True)), sum(n * q for (_, n), q in zip(rows, soft, strict=True))]
        for i, name in enumerate(LABELERS):
            for vote in "+-0":
                held = [(n, q) for (v, n), q in zip(rows, soft, strict=True) if v[i] == vote]
                for y, own in ((0, sum(n * (1 - q) for n, q in held)), (1, sum(n * q for n, q in held))):
                    chance[name, vote, y] = (own + 1) / (mass[y] + 3)
        prior = (mass[1] + 1) / (mass[0] + mass[1] + 2)
        odds = lambda v: math.log(prior / (1 - prior)) + sum(math.log(chance[name, v[i], 1] / chance[name, v[i], 0]) for i, name in enumerate(LABELERS))  # noqa: B023, E731
        soft = [1 / (1 + math.exp(-max(-30.0, min(30.0, odds(v))))) for v, _ in rows]
    return chance, prior, soft


def fit(counts: dict[str, int], rounds: int = 300) -> SpanModel:
    """EM over the counts of patterns (a bounded table: kinds, votes and shapes), then a logistic classifier on its soft labels."""
    if not counts:
        return SpanModel({}, 0.5, {}, -1.0)
    rows = sorted(counts.items())
    chance, prior, soft = reliabilities([(p.split("|")[1], n) for p, n in rows])
    seen = [features(p) for p, _ in rows]
    # Counts by their square root, so that one frequent pattern doesn't outweigh all others.
    mass = [math.sqrt(n) for _, n in rows]
    weights = dict.fromkeys(sorted({f for own in seen for f in own}), 0.0)
    bias, rate, whole = 0.0, 0.5, sum(mass)
    for _ in range(rounds):
        pull, up = dict.fromkeys(weights, 0.0), 0.0
        for own, q, n in zip(seen, soft, mass, strict=True):
            z = bias + sum(weights[f] for f in own)
            d = n * (q - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) / whole
            up += d
            for f in own:
                pull[f] += d
        bias += rate * up
        for f in weights:
            weights[f] += rate * (pull[f] - 0.001 * weights[f])
    return SpanModel(chance, prior, weights, bias)


SPANS = "array<struct<kind:string,s:int,e:int>>"


def with_candidates(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns), text, base (the base spans) and loose (the looser candidates that overlap none of them)."""
    spans = docs.select(whole(docs).alias("row"), "text").withColumn("base", base_spans(F.col("text")))
    return spans.withColumn("loose", apart(loose_spans(F.col("text")), F.col("base")))


def train(docs: DataFrame) -> SpanModel:
    """Votes over the candidates of all documents; what reaches the driver is one row for each distinct pattern of votes.

    Texts that can't hold a candidate are passed over: each has two digits next to each other or with one character
    between, a plus before a digit, an '@' or a spelt-out one.
    """
    few = docs.select("text").filter(F.col("text").rlike(r"[0-9][ .()-]?[0-9]|\+[0-9]|@|[(\[]at[)\]]"))
    both = F.concat(described(F.col("text"), F.col("base"), F.col("base"), True), described(F.col("text"), F.col("loose"), F.col("base"), False))
    rows = with_candidates(few).select(F.explode(both["pattern"]).alias("pattern"))
    return fit({r["pattern"]: r["count"] for r in rows.groupBy("pattern").count().collect()})


def accepted(model: SpanModel, pattern: Column) -> Column:
    """True if the classifier's score of the pattern is above 0."""
    kind, votes, shape = F.split_part(pattern, F.lit("|"), F.lit(1)), F.split_part(pattern, F.lit("|"), F.lit(2)), F.split_part(pattern, F.lit("|"), F.lit(3))
    told = [F.concat(F.lit("kind "), kind), F.concat(F.lit("shape "), shape), *[F.concat(F.lit(f"{name} "), F.substring(votes, i + 1, 1)) for i, name in enumerate(LABELERS)]]
    weights = F.create_map(*[F.lit(x) for pair in model.weights.items() for x in pair])
    return sum([F.coalesce(F.try_element_at(weights, f), F.lit(0.0)) for f in told], F.lit(float(model.bias))) > 0


def detect(docs: DataFrame, model: SpanModel) -> DataFrame:
    """row (a struct of all columns of ``docs``), text, base and added: array<struct<kind, s, e>> each.

    Null and empty texts have no spans. Whole texts are searched, whatever their length; repeated rows are treated
    alike, and columns other than text are passed on unread, whatever their names. Added spans never overlap base spans.
    An empty table gives an empty one.
    """
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    told = F.filter(described(F.col("text"), F.col("loose"), F.col("base"), False), lambda x: accepted(model, x["pattern"]))
    more = F.when(F.size("loose") > 0, plain(told)).otherwise(F.array().cast(SPANS)) if model.weights else F.array().cast(SPANS)
    return with_candidates(docs).select("row", "text", plain(F.col("base")).alias("base"), more.alias("added"))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    """By kind as listed (then 'id'), then start."""
    place = lambda k: F.array_position(F.array(*[F.lit(x) for x in (*KINDS, "id")]), k).cast("int")
    keyed = F.transform(spans, lambda x: F.struct(place(x["kind"]).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or union of overlapping spans, replaced by its kind in brackets."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def put(x: Column) -> Column:
        # What is before a span from the end of all spans before it; a span that begins before that is inside of one.
        one = lambda y, i: let(F.get(x["before"], i), lambda at: F.when(y["s"] < at, "").otherwise(F.concat(piece(x["blocks"], at, y["s"] - at), F.lit("["), F.upper(y["kind"]), F.lit("]"))))
        end = F.array_max(x["spans"]["e"])
        return F.concat(F.array_join(F.transform(x["spans"], one), ""), F.substring(text, end + 1, F.length(text)))

    held = let(ordered, lambda o: F.struct(o.alias("spans"), most_before(o["e"]).alias("before"), blocks_of(text).alias("blocks")))
    return F.when(F.size(spans) > 0, let(held, put)).otherwise(text)


def op1(docs: DataFrame) -> DataFrame:
    """The columns of the contract, and n_added. Null texts are empty ones; repeated rows are answered each."""
    done = detect(docs.select("doc_id", "text"), train(docs))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return done.select("row.doc_id", *[n(k) for k in KINDS], F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(in_order(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redacted(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs`` with each span in text replaced by its kind in brackets, [EMAIL]; n_chars, where there is one, follows.

    Rows, their order of columns and all other values stay; null and empty texts, and texts without spans, stay as they
    are. Repeated rows are treated alike, whatever other columns are named; an empty table gives an empty one.
    """
    done = detect(docs, model).select("row", redact(F.col("text"), F.concat("base", "added")).alias("clean"))
    row = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("clean").isNull(), F.col("row.n_chars")).otherwise(F.length("clean")).cast(docs.schema["n_chars"].dataType))
    return done.select(row.alias("row")).select("row.*")
