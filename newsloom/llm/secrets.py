"""Secret scans: base patterns, and weak parts of a credential that count only together. Native functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.functions.rows import compute_once
from newsloom.llm.common import text_or_empty
from newsloom.session import stage

MARK, STAND_IN = "\u0001", "\u0002"  # around matches; what stands for the mark where a text itself holds it
VALUE = "[A-Za-z0-9+/_.=-]"
SECRET, IDENTIFIER, ENDPOINT = "secret", "identifier", "endpoint"


@dataclass(frozen=True)
class Kind:
    """A pattern, the part of a credential that it is, and whether a match counts by itself.

    Runs are matched whole and the short ones dropped afterwards, where a shorter run could hide a later match.
    """

    name: str
    pattern: str
    role: str
    strong: bool
    value: str | None = None  # what precedes the value whose length counts
    shortest: int = 0
    mixed: bool = False  # must hold a digit, a capital and a small letter


# The base kinds, in their order.
BASE = (
    Kind(
        "assign",
        rf"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?{VALUE}+""",
        SECRET, True, r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", 8,
    ),
    Kind("access", "AKIA[A-Z0-9]{12,}", IDENTIFIER, True),
    Kind("hex", "[0-9a-f]{32,}", SECRET, True),
)
WEAK = (
    Kind(
        "identifier",
        r"""(?i)(?:access_key_id|client_id|user_?name|account_id|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}""",
        IDENTIFIER, False,
    ),
    Kind("endpoint", r"""(?i)[a-z][a-z0-9+]{1,15}://[^\x20\x09-\x0D"'<>]{4,}""", ENDPOINT, False),
    Kind("opaque", "[A-Za-z0-9+/_=-]{20,}", SECRET, False, mixed=True),
)
KINDS = BASE + WEAK
SPAN = "struct<start: int, kind: int, end: int>"


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The values combined from the first to each, for an operation such as a sum or a maximum of whole numbers.

    A fold that appends copies its array at every step. Here it goes over blocks of about the square root of the number of
    values, then over what the blocks come to, so no long array is ever copied for one element.
    """

    def fold(part: Column) -> Column:
        first = F.struct(part[0].alias("last"), F.array(part[0]).alias("all"))

        def step(acc: Column, v: Column) -> Column:
            new = combine(acc["last"], v)
            return F.struct(new.alias("last"), F.concat(acc["all"], F.array(new)).alias("all"))

        return F.aggregate(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(1))), first, step)

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        starts = F.sequence(F.lit(1), F.size(v), F.greatest(width, F.lit(1)))
        blocks = F.transform(starts, lambda s: fold(F.slice(v, s, width)))
        return text.let(
            blocks,
            lambda bs: text.let(
                fold(F.transform(bs, lambda x: x["last"]))["all"],
                lambda sums: F.flatten(
                    F.transform(
                        bs,
                        lambda x, i: F.when(i == 0, x["all"]).otherwise(
                            F.transform(x["all"], lambda y: combine(sums[i - 1], y))
                        ),
                    )
                ),
            ),
        )

    return text.let(values, whole)


def spans_of(clean: Column, number: int) -> Column:
    """The matches of a kind as ``array<SPAN>`` in code points, leftmost first, not overlapping.

    Matches are put between marks and the text is split there: every second piece is a match, and the lengths of what
    lies before it give its place.
    """
    kind = KINDS[number]

    def holds(piece: Column) -> Column:
        fine = F.lit(True)
        if kind.value:
            fine = F.char_length(F.regexp_replace(piece, kind.value, "")) >= kind.shortest
        if kind.mixed:
            fine = piece.rlike("[0-9]") & piece.rlike("[A-Z]") & piece.rlike("[a-z]")
        return fine

    def placed(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda p: F.char_length(p)), lambda a, b: a + b)

        def span(p: Column, i: Column, ends: Column) -> Column:
            return F.when(
                (i % 2 == 1) & holds(p),
                F.struct((ends[i] - F.char_length(p)).alias("start"), F.lit(number).alias("kind"), ends[i].alias("end")),
            )

        return text.let(ends, lambda e: F.filter(F.transform(pieces, lambda p, i: span(p, i, e)), lambda s: s.isNotNull()))

    none = F.array().cast(f"array<{SPAN}>")
    marked = F.split(F.regexp_replace(clean, f"({kind.pattern})", f"{MARK}$1{MARK}"), MARK)
    return text.let(marked, lambda pieces: F.when(F.size(pieces) > 1, placed(pieces)).otherwise(none))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    each = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(each, ",")


def scan(docs: DataFrame, column: str = "text", **carried: Column) -> DataFrame:
    """The ``carried`` columns and ``base, weak, text_key``: base matches, and weak ones in what these leave of the text.

    ``text_key`` is a digest of the text where there are weak matches and something to link them with, else null.
    """
    rows = docs.select(*[c.alias(name) for name, c in carried.items()], text_or_empty(column).alias("_text"))
    clean = F.translate("_text", MARK, STAND_IN)
    base = compute_once(rows, {"base": F.array_sort(F.concat(*[spans_of(clean, i) for i in range(len(BASE))]))})
    # what base spans cover is blanked out, line end by character, so weak matches are what remains beside them
    rest = F.when(F.size("base") > 0, masked(clean, F.col("base"), lambda n: F.repeat(F.lit("\n"), n))).otherwise(clean)
    base = compute_once(base, {"_rest": rest})
    found = compute_once(base, {"weak": F.concat(*[spans_of(F.col("_rest"), i) for i in range(len(BASE), len(KINDS))])})
    linkable = (F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)
    text_key = F.when(linkable, F.md5(F.col("_text").cast("binary"))).alias("text_key")
    return found.select(*carried, "base", "weak", text_key)


def link_parts(scanned: DataFrame, reach: int = 160) -> DataFrame:
    """``text_key, linked``: the weak matches of each text that complete a credential.

    A weak secret counts if an identifier or an endpoint begins or ends within ``reach`` code points of it, a weak
    identifier or endpoint if a secret does. This is an interval join of parts on the text and the stretches of
    ``reach`` code points that their scopes touch; a text that many rows share is joined once.
    """
    role = F.array(*[F.lit(k.role) for k in KINDS])
    parts = (
        scanned.filter("text_key IS NOT NULL").select("text_key", "base", "weak").dropDuplicates(["text_key"])
        .select("text_key", F.inline(F.concat("base", "weak")))
        .withColumn("secret", F.get(role, F.col("kind")) == SECRET)
    )

    def stretches(lowest: Column, highest: Column) -> Column:
        return F.explode(F.sequence(F.floor(lowest / reach), F.floor(highest / reach)))

    weak = parts.filter(F.col("kind") >= len(BASE)).withColumn(
        "_at", stretches(F.col("start") - reach, F.col("end") + reach)
    )
    other = parts.select(
        F.col("text_key").alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"),
        F.col("secret").alias("_secret"), stretches(F.col("start"), F.col("end")).alias("_at2"),
    )
    near = (
        (weak.text_key == other._key) & (weak._at == other._at2) & (weak.secret != other._secret)
        & (other._start <= weak.end + reach) & (weak.start <= other._end + reach)
    )
    return (
        weak.join(other, near, "left_semi").select("text_key", "start", "kind", "end").distinct()
        .groupBy("text_key").agg(F.collect_list(F.struct("start", "kind", "end").cast(SPAN)).alias("linked"))
    )


def _linked(scanned: DataFrame, reach: int) -> DataFrame:
    """``found`` and ``linked`` for scanned rows; only rows with weak parts are joined, the others never move."""
    none = F.array().cast(f"array<{SPAN}>")
    kept = [c for c in scanned.columns if c not in ("weak", "text_key")]
    alone = scanned.filter("text_key IS NULL").select(*kept, none.alias("linked"))
    joined = (
        scanned.filter("text_key IS NOT NULL").join(link_parts(scanned, reach), "text_key", "left")
        .select(*kept, F.coalesce("linked", none).alias("linked"))
    )
    return alone.unionByName(joined).withColumns(
        {"found": F.array_sort(F.concat("base", "linked")), "linked": F.array_sort("linked")}
    )


def find_secrets(docs: DataFrame, reach: int = 160, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, linked, found``: spans of each row's whole text, sorted by start and kind, in code points.

    ``base`` holds the matches of the base kinds, which count by themselves; ``linked`` the weak parts that complete a
    credential; ``found`` both. The scan's result is written to the shared folder once. Null and empty texts have no
    spans; repeated rows are scanned alike; an empty table gives no rows.
    """
    return _linked(stage(scan(docs, text, doc_id=F.col(f"`{key}`").cast("long")), "secrets"), reach)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans written out, for each row."""

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long").alias(f"n_{BASE[number].name}")

    counts = [count(i) for i in range(len(BASE))]
    return found.select(
        "doc_id", *counts,
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
    )


BLOCK = 1024  # code points of a text that are looked through at a time to cut a piece out of it


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """What lies between two places of a text that is cut into blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(F.greatest(end - 1, start) / BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substr(near, start - first * BLOCK + 1, end - start)).otherwise("")


def masked(whole: Column, spans: Column, instead: str | Callable[[Column], Column] = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced; spans that overlap or touch are one stretch.

    ``instead`` is a text, or makes one from the stretch's length. Spans come sorted by start. The text is cut into blocks
    once, so that no piece is looked for from the beginning.
    """

    def stand_in(length: Column) -> Column:
        return F.lit(instead) if isinstance(instead, str) else instead(length)

    def joined(blocks: Column, spans: Column, reached: Column) -> Column:
        n = F.size(spans)
        opens = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (spans[i]["start"] > F.get(reached, i - 1)))

        def cut(opens: Column) -> Column:
            def one(at: Column, k: Column) -> Column:
                start = spans[at]["start"]
                before = F.when(k == 0, F.lit(0)).otherwise(F.get(reached, at - 1))
                last = F.when(k + 1 < F.size(opens), F.get(opens, k + 1)).otherwise(n) - 1
                return F.concat(_between(blocks, before, start), stand_in(F.get(reached, last) - start))

            tail = _between(blocks, F.get(reached, n - 1), F.char_length(whole))
            return F.concat(F.array_join(F.transform(opens, one), ""), tail)

        return text.let(opens, cut)

    blocks = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return text.let(
        spans,
        lambda sp: text.let(
            running(F.transform(sp, lambda x: x["end"]), F.greatest),
            lambda reached: text.let(blocks, lambda bs: joined(bs, sp, reached)),
        ),
    )


def mask_secrets(docs: DataFrame, reach: int = 160, text: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; every row stays, texts without secrets as they are.

    Null and empty texts stay as they are; repeated rows are masked alike; an empty table gives no rows. The other
    columns travel as one, so no name can clash.
    """
    scanned = stage(scan(docs, text, _row=F.struct(*[F.col(f"`{c}`") for c in docs.columns])), "secrets")
    found = _linked(scanned, reach).select("_row", "found")
    old = F.col(f"_row.`{text}`")
    new = F.when(F.size("found") > 0, masked(old, F.col("found"))).otherwise(old)
    return found.select(
        *[(new if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]
    )
