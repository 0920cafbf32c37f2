"""Secrets in texts: three fixed patterns, and a battery of randomness tests for other tokens.

A token is a run of 20 or more letters, digits and ``+/_-`` (with ``=`` behind) that has a digit and a letter. Its
encoding is the smallest alphabet that holds it. Three tests take it as random in that alphabet: a chi-squared test
of uniformity over cells of five expected symbols, a runs test about the alphabet's middle, and a lag-one serial
correlation; Fisher's method joins their p-values into one.

Random tokens have evenly spread p-values, others small ones, smaller the longer they are. So false discoveries are
controlled for each encoding and band of lengths by itself: the tokens of all documents with p >= 0.5 tell how many
random ones there are, and the threshold is the smallest p at which at most ``fdr`` of the tokens above it are not
accounted for. Few tokens tell that number badly, so it is taken as high as what is seen allows (two standard errors):
a lone token counts as random unless its p lies in the lowest cell, up to eight names with larger p may be
reported for a group without random tokens, and in a large group the allowance vanishes beside the number itself. The
lowest cell, where the names are, counts only if it holds no more than random tokens would put there. A token at or
above its threshold, which overlaps no fixed match, is a further span.

Everything is built-in expressions: a text's spans are arrays in its row. A token counts once for the thresholds
however often it occurs, so a hash of each different token is shuffled, and counts per encoding, band and cell of
p-values (a few thousand rows) are brought together. Null and empty texts have no spans. Repeated rows are reported
each; spans are ordered by start, kind and end. An empty table gives an empty result. Input columns named like a
result are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import without

#: Fixed patterns by kind, with the least length of the group that counts (0: the match).
PATTERNS = {
    "assign": (
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
KINDS = [*PATTERNS, "random"]
TOKEN, TOKEN_LENGTH = r"[A-Za-z0-9+/_-]{20,}=*", 20
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the smallest alphabet to the largest.
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
#: Where bands of lengths begin.
LENGTHS = (20, 32, 48, 64, 128)
CELLS, FDR = 50, 0.1
#: Matches whose offsets are summed at a time.
_BLOCK = 256


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def offsets(text: Column, pattern: str, matches: Column) -> Column:
    """Start and end (code points) of each match: gaps and matches alternate, so their lengths add up to them.

    Sums run over blocks of matches and then over the blocks, so many matches don't cost their square.
    """
    lengths = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)),
        matches,
        lambda gap, match: F.struct(F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("match")),
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)),
    )

    def placed(block: Column) -> Column:
        """The spans of one block from 0, and where it ends."""
        spans = F.array().cast("array<struct<start:bigint,end:bigint>>")
        return F.aggregate(
            block,
            F.struct(_long(0).alias("at"), spans.alias("spans")),
            lambda s, x: F.struct(
                (s["at"] + x["gap"] + x["match"]).alias("at"),
                F.array_append(
                    s["spans"],
                    F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["match"]).alias("end")),
                ).alias("spans"),
            ),
        )

    whole = F.aggregate(
        F.transform(blocks, placed),
        F.struct(
            _long(0).alias("at"), F.array().cast("array<array<struct<start:bigint,end:bigint>>>").alias("parts")
        ),
        lambda s, b: F.struct(
            (s["at"] + b["at"]).alias("at"),
            F.array_append(
                s["parts"],
                F.transform(
                    b["spans"],
                    lambda x: F.struct((x["start"] + s["at"]).alias("start"), (x["end"] + s["at"]).alias("end")),
                ),
            ).alias("parts"),
        ),
    )
    return F.flatten(whole["parts"])


def _located(text: Column, pattern: str, group: int, least: int) -> Column:
    """The matches whose group has ``least`` characters: start, end, and the group's text."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    found = F.arrays_zip(offsets(text, pattern, matches).alias("at"), groups.alias("token"))
    found = F.transform(
        F.filter(found, lambda x: F.length(x["token"]) >= least),
        lambda x: F.struct(x["at"]["start"].alias("start"), x["at"]["end"].alias("end"), x["token"].alias("token")),
    )
    return F.when(F.exists(groups, lambda g: F.length(g) >= least), found).otherwise(F.array().cast(_FOUND))


_FOUND = "array<struct<start:bigint,end:bigint,token:string>>"


def _tail(z: Column) -> Column:
    """The upper tail of the normal distribution, to 1e-4 (a logistic curve)."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _steps(column: Column, *adds) -> Column:
    """An array of structs with fields added step by step, so that each is computed once."""

    def extended(add):
        return lambda x: reduce(lambda s, field: s.withField(*field), add(x).items(), x)

    for add in adds:
        column = F.transform(column, extended(add))
    return column


def battery(tokens: Column) -> Column:
    """Tokens (start, end, token) of a known encoding, with encoding, band, and ``p`` under randomness."""
    body = lambda x: F.rtrim(x["token"], F.lit("="))

    def encoding(x: Column) -> dict[str, Column]:
        found = F.coalesce(
            *(F.when(F.translate(body(x), a, "") == "", F.lit(name)) for name, a in ALPHABETS.items()), F.lit("")
        )
        mixed = body(x).rlike("[0-9]") & body(x).rlike("[A-Za-z]") & (F.length(body(x)) >= TOKEN_LENGTH)
        return {"encoding": F.when(mixed, found).otherwise("")}

    def symbols(x: Column) -> dict[str, Column]:
        alphabets = F.create_map(*(F.lit(v) for pair in ALPHABETS.items() for v in pair))
        letters = alphabets[x["encoding"]]
        values = F.transform(F.split(body(x), ""), lambda c: (F.position(c, letters) - 1).cast("int"))
        n, k = F.length(body(x)), F.length(letters)
        # The largest power of two with five expected symbols to a cell.
        cells = F.least(F.lit(64), k, F.pow(F.lit(2), F.floor(F.log2(n / 5.0)))).cast("int")
        band = F.size(F.filter(F.array(*map(F.lit, LENGTHS)), lambda b: n >= b))
        return {"v": values, "n": n, "k": k, "g": F.greatest(cells, F.lit(2)), "band": band}

    def statistics(x: Column) -> dict[str, Column]:
        v, n, k, g = x["v"], x["n"].cast("double"), x["k"], x["g"]

        def cell(c: Column) -> Column:
            count = F.size(F.filter(v, lambda s: F.floor(s * g / k) == c)).cast("double")
            members = F.ceil((c + 1) * k / g) - F.ceil(c * k / g)
            return count * count * k / (n * members)

        add = lambda a, b: a + b
        chi = F.aggregate(F.transform(F.sequence(F.lit(0), g - 1), cell), F.lit(0.0), add) - n
        high = F.size(F.filter(v, lambda s: s * 2 >= k)).cast("double")
        pairs = F.zip_with(
            F.slice(v, F.lit(1), x["n"] - 1), F.slice(v, F.lit(2), x["n"] - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        )
        runs = 1 + F.size(F.filter(pairs, lambda p: (p["a"] * 2 >= k) != (p["b"] * 2 >= k)))
        middle = (k - 1) / 2.0
        spread = F.aggregate(F.transform(v, lambda s: (s - middle) * (s - middle)), F.lit(0.0), add)
        along = F.aggregate(F.transform(pairs, lambda p: (p["a"] - middle) * (p["b"] - middle)), F.lit(0.0), add)
        return {"chi": chi, "high": high, "runs": runs.cast("double"), "serial": along / spread * F.sqrt(n)}

    def values(x: Column) -> dict[str, Column]:
        n, free = x["n"].cast("double"), (x["g"] - 1).cast("double")
        # Wilson and Hilferty: the cube root of chi-squared per degree of freedom is nearly normal.
        a = 2 / (9 * free)
        uniform = _tail((F.pow(F.greatest(x["chi"], F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - a)) / F.sqrt(a))
        mean = 2 * x["high"] * (n - x["high"]) / n + 1
        deviation = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
        runs = F.when(deviation > 0, 2 * _tail(F.abs(x["runs"] - mean) / deviation)).otherwise(0.0)
        least = F.lit(1e-12)
        half = -sum(F.log(F.greatest(p, least)) for p in (uniform, runs, 2 * _tail(F.abs(x["serial"]))))
        return {"half": half}

    # Fisher's sum has twice three degrees of freedom, whose tail is a finite sum.
    joint = lambda x: {"p": F.exp(-x["half"]) * (1 + x["half"] + x["half"] * x["half"] / 2)}
    known = F.filter(_steps(tokens, encoding), lambda x: x["encoding"] != "")
    tested = _steps(known, symbols, statistics, values, joint)
    return F.transform(
        tested,
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.concat_ws("/", x["encoding"], x["band"].cast("string")).alias("group"),
            F.least(F.floor(x["p"] * CELLS), F.lit(CELLS - 1)).cast("int").alias("cell"),
            F.xxhash64(body(x)).alias("hash"),
        ),
    )


def tokens(text: Column) -> Column:
    """The tested tokens of a text: start, end, group (encoding and band), cell of the p-value, and a hash."""
    return battery(_located(text, TOKEN, 0, TOKEN_LENGTH))


def thresholds(tested: DataFrame, column: str = "tokens", fdr: float = FDR) -> DataFrame:
    """One row per group: the lowest cell of p-values whose tokens count as random."""
    cells = (
        tested.select(F.explode(column).alias("t"))
        .select("t.group", "t.cell", "t.hash")
        .distinct()
        .groupBy("group", "cell")
        .agg(F.count("*").alias("n"))
        .groupBy("group")
        .agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    )

    def above(least: Column) -> Column:
        held = F.filter("cells", lambda x: x["cell"] >= least)
        return F.aggregate(held, _long(0), lambda a, x: a + x["n"]).cast("double")

    seen = above(F.lit(CELLS // 2))
    # The largest number of which as few as were seen are likely (the upper limit of a Poisson count).
    random = 2 * F.pow(F.sqrt(seen + 1) + 1, F.lit(2.0))
    due = 2 * seen / CELLS
    # Two standard deviations above what random tokens put in the lowest cell.
    plain = above(F.lit(0)) - above(F.lit(1)) <= due + 2 * F.sqrt(due)
    fits = lambda t: (
        (above(t) > 0) & ((t > 0) | plain) & (random * (1 - t / CELLS) >= (1 - fdr) * above(t))
    )
    lowest = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(CELLS // 2)), fits))
    return cells.select("group", F.coalesce(lowest, F.lit(CELLS)).alias("lowest"))


def scan(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """``docs`` with ``spans``: an array of start, order, kind and end, by start, kind and end.

    Texts are read twice: once for the thresholds, which need all documents, and once for the spans.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    groups = thresholds(docs.select(tokens(value).alias("tokens")), fdr=fdr)
    # At most encodings times bands entries.
    table = groups.agg(F.map_from_entries(F.collect_list(F.struct("group", "lowest"))).alias("m")).scalar()
    kept = [f"`{c}`" for c in without(docs, ["spans"])]
    found = docs.select(*kept, value.alias("_text"))
    for kind, (pattern, group, least) in PATTERNS.items():
        found = found.withColumn(f"_{kind}", _located(F.col("_text"), pattern, group, least))

    def spans(column: Column, kind: str) -> Column:
        order = F.lit(KINDS.index(kind))
        return F.transform(
            column,
            lambda x: F.struct(
                x["start"].alias("start"), order.alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end")
            ),
        )

    base = F.concat(*(spans(F.col(f"_{kind}"), kind) for kind in PATTERNS))
    found = found.withColumn("_base", base).withColumn("_tokens", tokens(F.col("_text"))).withColumn("_lowest", table)
    random = F.filter(
        "_tokens",
        lambda t: (t["cell"] >= F.coalesce(F.col("_lowest")[t["group"]], F.lit(CELLS)))
        & ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    every = F.array_sort(F.concat("_base", spans(random, "random")))
    return found.select(*kept, every.alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in place of each run of overlapping spans; nulls and texts without spans stay."""
    span = "array<struct<start:bigint,end:bigint>>"
    runs = F.aggregate(
        spans,
        F.array().cast(span),
        lambda runs, s: F.when(
            (F.size(runs) > 0) & (s["start"] < F.element_at(runs, -1)["end"]),
            F.concat(
                F.slice(runs, F.lit(1), F.size(runs) - 1),
                F.array(
                    F.struct(
                        F.element_at(runs, -1)["start"].alias("start"),
                        F.greatest(F.element_at(runs, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.array_append(runs, F.struct(s["start"].alias("start"), s["end"].alias("end")))),
    )
    docs = docs.withColumn("_runs", F.when(F.size(spans) > 0, runs))
    ends = F.concat(F.array(_long(0)), F.transform("_runs", lambda r: r["end"]))
    starts = F.concat(F.transform("_runs", lambda r: r["start"]), F.array(F.length(text).cast("long")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int")))
    return docs.withColumn(
        text, F.when(F.col("_runs").isNotNull(), F.array_join(pieces, mark)).otherwise(F.col(text))
    ).drop("_runs")
