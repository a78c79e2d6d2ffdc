"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss.

All work is DataFrame expressions. The fixed patterns give base spans. They are the seeds: the words around them are
lexical patterns, and every identifier-like token stands between such words too. Pattern and token form a graph in which
Spark scores in turns: a pattern by the share of its tokens that are known to be of a kind, a token by the patterns it
stands in. Tokens with a high score are identifiers the fixed patterns did not see, and become seeds of the next turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import free, stored

KINDS = ("email", "ip", "card", "phone")

# The fixed patterns, in the order of KINDS. Each is the rule in the comment in a form whose repetition is over single
# characters, so that the regular expression engine needs no recursion, and that starts once per run of characters.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?!\.?[A-Za-z0-9-])",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ with 14 digits or more
    "card": r"(?=[0-9](?:[\x20-]?[0-9]){13})[0-9][0-9\x20-]*?(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# what a text must contain to be searched at all
NEEDED = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
# a token: a run without white space that has a digit or an @
TOKEN = r"(?:\G|(?<!\S))[^\s0-9@]*+[0-9@]\S*+"
# a run of digits joined by single spaces, dashes, dots and brackets, the signs of the card and phone rules; a + or an opening
# bracket starts a new run, a word that has letters ends it
RUN = (
    r"(?<![\p{L}\p{N}])\+?(?:[0-9]{1,3}+[\x20.-]?(?=\())?\(?[0-9]++(?![\p{L}\p{N}])"
    r"(?:(?:\x20(?!\x20)|\.(?=[0-9])|[)-]){1,3}[0-9]++(?![\p{L}\p{N}]))++"
)
EDGE = r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$"
# fewest and most digits, and the signs, of a token or run that may become one of a kind
SHAPES = {"email": (0, 99, r"^[^@]+@[^@]+$"), "ip": (4, 12, r"^[0-9]+([.:][0-9]+)+$"), "card": (12, 19, r"^[0-9][0-9\x20-]+$"), "phone": (7, 15, r"^\+?[0-9(][0-9().\x20-]+$")}
WORD = 64  # longest word of a context


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _before(values: Column, fold: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """For each number of an array the fold (sum or maximum, from 0) of those before it, block by block, so that long arrays stay cheap."""

    def run(start: Column, part: Column) -> Column:
        zero = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, x: F.struct(fold(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(part, zero, step, lambda a: a["out"])

    def whole(x: Column) -> Column:
        part = lambda b: F.slice(x, b * block + 1, block)
        numbers = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int"))
        folded = F.transform(numbers, lambda b: F.aggregate(part(b), F.lit(0).cast("bigint"), fold))
        starts = lambda s: F.flatten(F.zip_with(run(F.lit(0), s), numbers, lambda start, b: run(start, part(b))))
        return F.when(F.size(x) > 0, _let(folded, starts)).otherwise(F.array().cast("array<bigint>"))

    return _let(values, whole)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str) -> Column:
    """array of (start, end, match, left, right), in code points, of all matches of a pattern, left to right.

    left and right are the words next to the match, lower-cased, whole, up to WORD signs; nothing where the text ends or the
    word is longer. They are cut from the pieces between the matches, never from the whole text: a word may hold the
    neighbouring match, and it ends where that match's own neighbour begins.
    """

    def spans(t: Column) -> Column:
        gaps, found = t["gaps"], t["found"]
        before = F.slice(gaps, 1, F.size(found))
        sizes = lambda x: F.transform(x, lambda m: F.length(m).cast("bigint"))
        start = F.zip_with(_before(F.zip_with(sizes(before), sizes(found), _sum), _sum), sizes(before), _sum)
        last = F.size(found) - 1

        def one(m: Column, i: Column) -> Column:
            ahead = F.concat(F.when(i > 0, F.get(found, i - 1)).otherwise(""), F.get(gaps, i))
            behind = F.concat(F.get(gaps, i + 1), F.when(i < last, F.concat(F.get(found, i + 1), F.get(gaps, i + 2))).otherwise(""))
            left = F.lower(F.regexp_extract(ahead, r"(?:^|\s)(\S{1,%d}+)\s*+$" % WORD, 1))
            right = F.lower(F.regexp_extract(behind, r"^\S*+\s++(\S{1,%d}+)(?!\S)" % WORD, 1))
            return F.struct(F.length(m).alias("size"), m.alias("match"), left.alias("left"), right.alias("right"))

        placed = F.transform(found, one)
        return F.zip_with(
            start, placed, lambda s, m: F.struct(s.alias("start"), (s + m["size"]).alias("end"), m["match"].alias("match"), m["left"].alias("left"), m["right"].alias("right"))
        )

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return _let(parts, spans)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has the check digit of a card number."""

    def one(d: Column, i: Column) -> Column:
        v = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    values = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), one)
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        return _let(_digits(m), lambda d: F.length(d).between(14, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


SPAN = "array<struct<start:bigint,end:bigint,kind:int,match:string>>"


CONTEXTS = "array<struct<start:bigint,end:bigint,kind:int,match:string,left:string,right:string>>"


def _base(text: Column) -> Column:
    """array of (start, end, kind, match, left, right) of the fixed patterns, kind as its place in KINDS, kind by kind."""

    def of(n: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda s: _holds(kind, s["match"]))
        return F.when(NEEDED[kind](text), F.transform(found, lambda s: _span(s, F.lit(n)))).otherwise(F.array().cast(CONTEXTS))

    return F.concat(*[of(n, kind) for n, kind in enumerate(KINDS)])


def _span(s: Column, kind: Column) -> Column:
    names = ("match", "left", "right")
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), *[s[n].alias(n) for n in names])


def base_spans(text: Column) -> Column:
    """array of (start, end, kind, match) of the fixed patterns, kind as its place in KINDS, by start and kind."""
    return ordered(_base(text))


def ordered(spans: Column) -> Column:
    """(start, end, kind, match) by start, then kind, then end."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"], s["match"]))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match")))


def written(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    name = lambda n: F.element_at(F.array(*[F.lit(k) for k in KINDS]), n + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scan(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, base) of every row, and (row, id, text_hash, start, end, kind or -1, value, left, right) of its base
    matches, its tokens and its runs of digits; tokens and runs that touch a base match are left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64(text))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string,left:string,right:string>>")
    tokens = F.when(text.rlike("[0-9@]"), matches(text, TOKEN)).otherwise(none)
    runs = F.when(text.rlike("[0-9][\\x20.()-]{1,3}[0-9]"), matches(text, RUN)).otherwise(none)

    def trimmed(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["match"], r"^[^\p{L}\p{N}+]*", 0))
        core = F.regexp_replace(s["match"], EDGE, "")
        return F.struct(
            (s["start"] + lead).alias("start"), (s["start"] + lead + F.length(core)).alias("end"), F.lit(-1).alias("kind"),
            core.alias("match"), s["left"].alias("left"), s["right"].alias("right"), s["start"].alias("from"), s["end"].alias("to"),
        )

    whole = lambda s: _span(s, F.lit(-1)).withField("from", s["start"]).withField("to", s["end"])
    others = F.concat(F.transform(tokens, trimmed), F.transform(runs, whole))
    others = F.filter(others, lambda s: possible(s["match"]))
    found = slim.withColumn("own", _base(text)).select("id", "text_hash", ordered(F.col("own")).alias("base"), "own", others.alias("others"))
    kept = stored(found.withColumn("row", F.monotonically_increasing_id()), "scan")
    own = kept.select("row", "id", "text_hash", F.inline(F.transform("own", lambda s: s.withField("from", s["start"]).withField("to", s["end"]))))
    # a token touches a base match if one that starts before it reaches into it, or one that starts within it follows
    both = own.unionByName(kept.where(F.size("own") > 0).select("row", "id", "text_hash", F.inline("others")))
    until = (Window.unboundedPreceding, -1)
    here = Window.partitionBy("row")
    reach = F.max(F.when(F.col("kind") >= 0, F.col("to"))).over(here.orderBy("from", F.desc("kind")).rowsBetween(*until))
    ahead = F.min(F.when(F.col("kind") >= 0, F.col("from"))).over(here.orderBy(F.desc("from"), "kind").rowsBetween(*until))
    both = both.withColumn("reach", reach).withColumn("ahead", ahead)
    clear = (F.col("kind") >= 0) | ((F.coalesce("reach", F.lit(0)) <= F.col("from")) & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("to"))))
    alone = kept.where(F.size("own") == 0).select("row", "id", "text_hash", F.inline("others"))
    seen = both.where(clear).select(*alone.columns).unionByName(alone)
    seen = seen.select("row", "id", "text_hash", "start", "end", "kind", F.lower("match").alias("value"), "left", "right")
    return kept.select("id", "text_hash", "base"), stored(seen, "seen")


def shape(kind: str, value: Column) -> Column:
    """Whether a token could be an identifier of a kind."""
    least, most, signs = SHAPES[kind]
    return value.rlike(signs) & F.length(_digits(value)).between(least, most)


def possible(value: Column) -> Column:
    out = F.lit(False)
    for kind in KINDS:
        out = out | shape(kind, value)
    return out


def learn(seen: DataFrame, most_rounds: int, support: int, pattern_score: float, value_score: float) -> DataFrame:
    """(value, kind) of identifiers found by their contexts, from (value, kind or -1, left, right) of every occurrence.

    A pattern is a left word, a right word, or both. Its score for a kind is the sum of its known values' scores over
    one more than its number of different values; it counts from `support` known values and pattern_score on. A value's
    score is 1 - product of (1 - score) over its patterns; from value_score on it is known in the next round, if its shape
    allows. A value keeps the kind it was first found as, so that what is found only grows; the rounds end when a round adds
    nothing. Everything is counted over all occurrences; groups are reduced before they are shuffled.
    """
    left = F.when(F.col("left") != "", F.concat_ws(" ", F.lit("<"), "left"))
    right = F.when(F.col("right") != "", F.concat_ws(" ", F.lit(">"), "right"))
    both = F.when((F.col("left") != "") & (F.col("right") != ""), F.concat_ws(" ", F.lit("<"), "left", F.lit(">"), "right"))
    edges = seen.select("value", "kind", F.explode(F.array(left, right, both)).alias("pattern")).where("pattern is not null")
    edges = stored(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    known = edges.where("kind >= 0").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    seeded = known.select("value").distinct()
    fan = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= support)
    live = stored(edges.join(fan, "pattern"), "live")  # a pattern with fewer values never counts, whatever becomes known
    open_edges = live.where("kind < 0").join(seeded, "value", "left_anti").select("pattern", "value")
    found, size = None, 0
    for _ in range(most_rounds):
        scored = live.select("pattern", "value", "values").join(known, "value").groupBy("pattern", "kind")
        scored = scored.agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("of"), F.max("values").alias("values"))
        scored = scored.withColumn("p", F.col("sum") / (F.col("values") + 1)).where((F.col("of") >= support) & (F.col("p") >= pattern_score))
        scored = stored(scored.select("pattern", "kind", "p"), "patterns")
        new = open_edges.join(scored, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("p"))))).alias("score"))
        fits = F.lit(False)
        for n, kind in enumerate(KINDS):
            fits = fits | ((F.col("kind") == n) & shape(kind, F.col("value")))
        new = new.where((F.col("score") >= value_score) & fits)
        if found is not None:
            held = found.select("value", F.col("kind").alias("held"))
            new = new.join(held, "value", "left").where("held is null or held = kind")
        found = stored(new.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("top")).select("value", (-F.col("top.k")).alias("kind"), F.col("top.score").alias("score")), "values")
        known = edges.where("kind >= 0").select("value", "kind").distinct().withColumn("score", F.lit(1.0)).unionByName(found)
        last, size = size, found.count()
        if size <= last:
            break
    else:
        raise RuntimeError("the identifiers did not settle")
    return found.select("value", "kind")


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rounds: int = 200, support: int = 5, pattern_score: float = 0.6, value_score: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """((id, text_hash, base, spans) for every row, extra (id, text_hash, more) of texts with spans the method added).

    base and spans are arrays of (start, end, kind, match), spans all of them; added ones touch no base span. Null and empty
    texts have none. Rows with equal id and text have equal spans; rows that only share an id are told apart by their text.
    """
    scan, seen = _scan(docs, id_col, text_col)
    values = learn(seen.select("value", "kind", "left", "right"), most_rounds, support, pattern_score, value_score)
    rows = seen.where("kind < 0").select("id", "text_hash", "start", "end", "value").distinct().join(values, "value")
    ahead = Window.partitionBy("id", "text_hash").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reach", F.max("end").over(ahead)).where("reach is null or end > reach")  # a token within a found run is part of it
    span = F.struct("start", "end", "kind", F.col("value").alias("match"))
    extra = stored(rows.groupBy("id", "text_hash").agg(F.collect_list(span).alias("more")), "extra")
    named = extra.toDF("own_id", "own_hash", "more")
    both = scan.select("id", "text_hash", "base").join(named, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")), "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(ordered(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))))
    return both.select("id", "text_hash", "base", spans.alias("spans")), extra


def _pieces(text: Column, use: Callable[[Callable[[Column, Column], Column]], Column], block: int = 2048) -> Column:
    """use(piece) where piece(a, b) is the text from place a up to b: texts are cut into blocks once, and a piece out of its blocks."""

    def cut(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / block).cast("int")
            own = F.slice(blocks, first + 1, F.greatest(F.floor((b - 1) / block).cast("int") - first + 1, F.lit(0)))
            return F.when(b > a, F.substring(F.array_join(own, ""), (a - first * block + 1).cast("int"), (b - a).cast("int"))).otherwise("")

        return use(piece)

    numbers = F.sequence(F.lit(0), F.floor(F.length(text) / block).cast("int"))
    return _let(F.transform(numbers, lambda i: F.substring(text, i * block + 1, F.lit(block))), cut)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per document: the number of base spans of each kind, a digest of the base spans, and all spans as text."""
    found, _ = find(docs, id_col, text_col, **settings)

    def count(n: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long").alias(f"n_{KINDS[n]}")

    counts = [count(n) for n in range(len(KINDS))]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **settings) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, [EMAIL]; n_chars follows the text. Nulls stay null.

    Of spans that overlap, the one that starts first is replaced, and the rest of the later one goes with it.
    """
    _, extra = find(docs, id_col, text_col, **settings)
    own, mark, more = (free(docs, n) for n in ("pii_id", "pii_hash", "pii_more"))
    extra = extra.toDF(own, mark, more)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    same = docs[id_col].eqNullSafe(extra[own]) & (F.xxhash64(text) == extra[mark])
    both = docs.join(extra, same, "left")
    spans = F.concat(base_spans(text), F.coalesce(F.col(more), F.array().cast(SPAN)))
    label = lambda n: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), n + 1)

    def replaced(found: Column) -> Column:
        """Pieces and labels in turn; the end of all earlier spans is where a piece may begin."""
        at = _before(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        end = F.aggregate(found, F.lit(0).cast("bigint"), lambda a, s: F.greatest(a, s["end"]))
        both = lambda piece: F.zip_with(found, at, lambda s, a: F.when(s["start"] >= a, F.concat(piece(a, s["start"]), label(s["kind"]))).otherwise(""))
        return _pieces(text, lambda piece: F.concat(F.array_join(both(piece), ""), piece(end, F.length(text).cast("bigint"))))

    clean = _let(spans, lambda x: F.when(F.size(x) > 0, _let(ordered(x), replaced)).otherwise(text))
    clean = F.when(F.col(f"`{text_col}`").isNotNull(), clean)
    fresh = free(docs, "pii_text")
    out = both.withColumn(fresh, clean)
    kept = []
    for c in docs.columns:
        if c == text_col:
            kept.append(F.col(fresh).alias(c))
        elif c == chars_col:
            kept.append(F.when(F.col(fresh).isNull(), F.col(f"`{c}`")).otherwise(F.length(fresh)).cast(docs.schema[c].dataType).alias(c))
        else:
            kept.append(docs[c])
    return out.select(*kept)
