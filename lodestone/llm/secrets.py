"""Secret scans, in DataFrame functions only.

Base: fixed patterns (assign, access, hex), leftmost and not overlapping within a
kind.  The method adds entropy spans: runs of 20 or more of [A-Za-z0-9+/_=-] in
which some window of 20 characters has a high Shannon entropy for the run's
character class (hex digits, letters only, anything).  The counts of the window's
characters are carried along; it slides by taking one character out and one in, and
the sum of c * log2(c) changes by those two counts alone.  The sums are whole numbers
(units of 2**-20), so results are exact and repeatable.  Runs that an allow-list pattern fits, or that
lie within a base span, are left out.

With alphabets (as the query and the pipeline ask), a run is also a span when some
window reaches what nearly all random windows of its own alphabet have, and half
of its neighbouring characters or more are unlike words: letter pairs that are
rare in English, German, French and Spanish, a letter beside a digit, a capital
after a small letter.  The second test keeps words, paths and names out.  There,
an allow-list pattern that isn't anchored only takes out the windows on its piece.

Spans are kind:start:end in code points from 0, end exclusive.

Edge cases: a null text is an empty one, without spans; repeated rows are scanned
each; an empty table gives no rows; a run of any length is scanned whole (in
overlapping pieces); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW, PIECE = 20, 1000
#: bits a character over a window, by class of the run
LIMITS = {"hex": 3.0, "letters": 4.15, "mixed": 3.9}
#: runs that are no secrets: UUIDs, examples, alphabets, one character over and over
ALLOW = (r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", r"(?i)example|placeholder|your[_-]", r"(?i)abcdefghij|0123456789", r"^(.)\1+$")
#: alphabets of a window, first that fits, and the bits a character that 99.5 % of its random windows have
ALPHABETS = ((r"^([a-z]+|[A-Z]+)$", 3.16), (r"^[A-Z2-7]+$", 3.28), (r"^([a-z0-9]+|[A-Z0-9]+)$", 3.34), (r"^[A-Za-z]+$", 3.52), (r"^.", 3.58))
#: the commonest letter pairs of words; of a window's 19 pairs so many are unlike words at least
PAIRS = (
    "th er in on re he en an ti nt le es at or nd st se de te ne ea ha el ng ed ch io ou it et me no is ar as ue na to ie ra ei al ro ly sh tr co of lf bl "
    "ta wh ee li un au be ge ns ai ci la pa ur ec ri ho di if rt ve ll ac do rn hi fo am qu ic ni os rr il si tu ct ex ht fi od ot rs pe nc ad ss ef ma ce "
    "sc lo ux ts ke om im eo da ut tt ul ca po pr nn em nh mp ls hh op mo ep cl oi wi hs va nl us pt rg so hn eu oc mi fr pl ck su ae vi wa gs ty sa lu ir"
).split()
UNLIKE = r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])|(?!(?i:" + "|".join(PAIRS) + r"))[A-Za-z](?=[A-Za-z])"
LEAST_UNLIKE = 10
#: stands for an allowed piece of a run; no window goes across it
_CUT = "~"
_UNIT = 1 << 20


def _units(c: int) -> int:
    return round(_UNIT * c * math.log2(c)) if c else 0


def limit_units(bits: float, window: int = WINDOW) -> int:
    """A window's entropy is at least bits if its sum of c * log2(c) is at most this."""
    return math.floor(_UNIT * window * (math.log2(window) - bits))


_SPAN = "struct<kind:int,s:bigint,e:bigint>"
_NONE = f"array<{_SPAN}>"


def _spans(text: Column, kind: int, pattern: str, guard: Column, value_group: int, least: int) -> Column:
    """All matches as (kind, start, end), those whose value group is shorter than least left out.

    Starts are the running lengths of what stands between matches and of the matches.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_NONE).alias("out"))
    step = lambda acc, p: F.struct(
        (acc["at"] + p["0"] + F.coalesce(p["1"], F.lit(0))).alias("at"),
        F.when(p["2"] >= least, F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), (acc["at"] + p["0"]).alias("s"), (acc["at"] + p["0"] + p["1"]).alias("e"))))).otherwise(acc["out"]).alias("out"),
    )
    parts = F.arrays_zip(gaps, F.transform(whole, lambda x: F.length(x).cast("long")), F.transform(value, F.length))
    return F.when(guard, F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_NONE))


#: the characters of runs, and digits for counts up to a window's length
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-" + _CUT
_DIGITS = "0123456789abcdefghijklmnop"


def _window_sums(piece: Column) -> Column:
    """Sum of c * log2(c), in units, of each window of a piece, in order.

    The counts of the window's characters are carried along, a digit for each sign;
    a step takes one character out and one in, and changes those two counts alone.
    """
    table = F.array(*[F.lit(_units(c)).cast("long") for c in range(WINDOW + 2)])
    f = lambda c: F.get(table, c)
    sign = lambda i: F.instr(F.lit(SIGNS), F.substr(piece, i, F.lit(1)))
    count = lambda counts, k: F.instr(F.lit(_DIGITS), F.substr(counts, k, F.lit(1))) - 1
    put = lambda counts, k, c: F.overlay(counts, F.substr(F.lit(_DIGITS), c + 1, F.lit(1)), k, F.lit(1))
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def step(acc: Column, i: Column) -> Column:
        def out(k: Column) -> Column:  # the character that leaves
            return F.when(i > WINDOW, F.struct(put(acc["counts"], k, count(acc["counts"], k) - 1).alias("counts"), (acc["s"] - f(count(acc["counts"], k)) + f(count(acc["counts"], k) - 1)).alias("s"))).otherwise(F.struct(acc["counts"].alias("counts"), acc["s"].alias("s")))

        def come(x: Column) -> Column:  # the character that comes
            k, had = sign(i), count(x["counts"], sign(i))
            s = x["s"] + f(had + 1) - f(had)
            return F.struct(put(x["counts"], k, had + 1).alias("counts"), s.alias("s"), F.when(i >= WINDOW, F.concat(acc["sums"], F.array(s))).otherwise(acc["sums"]).alias("sums"))

        return bound(bound(sign(F.greatest(i - WINDOW, F.lit(1))), out), come)

    zero = F.struct(F.lit("0" * len(SIGNS)).alias("counts"), F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("sums"))
    return F.aggregate(F.sequence(F.lit(1), F.length(piece)), zero, step, lambda acc: acc["sums"])


def _pieces(run: Column) -> Column:
    """A run in pieces that overlap by a window less one, so that every window lies in one of them."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - WINDOW + 1), F.lit(PIECE - WINDOW + 1))
    return F.transform(at, lambda i: F.substr(run, i, F.lit(PIECE)))


def _high_window(run: Column, most: Column) -> Column:
    return F.exists(_pieces(run), lambda piece: F.coalesce(F.array_min(_window_sums(piece)) <= most, F.lit(False)))


def _random_window(run: Column, alphabets) -> Column:
    """Whether some window is unlike words and has the entropy of random characters of its alphabet."""

    def found(x: Column) -> Column:
        def random(w: Column) -> Column:
            window, pairs = F.substr(x["piece"], w["i"], F.lit(WINDOW)), F.substr(x["marks"], w["i"], F.lit(WINDOW - 1))
            most = F.coalesce(*[F.when(window.rlike(pattern), limit_units(bits)) for pattern, bits in alphabets])
            return (F.length(pairs) - F.length(F.replace(pairs, F.lit("!"), F.lit(""))) >= LEAST_UNLIKE) & ~F.contains(window, F.lit(_CUT)) & (w["sum"] <= most)

        return F.exists(F.transform(x["sums"], lambda s, i: F.struct(s.alias("sum"), (i + 1).alias("i"))), random)

    # what a piece's windows share is made once for the piece
    made = F.transform(_pieces(run), lambda piece: F.struct(piece.alias("piece"), F.regexp_replace(piece, UNLIKE, "!").alias("marks"), _window_sums(piece).alias("sums")))
    return F.exists(made, found)


def base_spans(text: Column) -> Column:
    return F.concat(
        _spans(text, 0, ASSIGN, text.rlike(ASSIGN), 2, 12),
        _spans(text, 1, ACCESS, F.contains(text, F.lit("AKIA")), 0, 18),
        _spans(text, 2, HEX, text.rlike(r"[0-9a-f]{16}"), 0, 16),
    )


def entropy_spans(text: Column, base: Column, limits=LIMITS, allow=ALLOW, alphabets=None) -> Column:
    """Spans of runs with a window of high entropy, without allowed ones and those within a base span."""
    runs = _spans(text, 3, RUN, text.rlike(RUN), 0, WINDOW)
    run_of = lambda x: F.substr(text, (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int"))

    def secret(x: Column) -> Column:
        run = run_of(x)
        most = F.when(run.rlike("^[0-9a-fA-F]+$"), limit_units(limits["hex"])).when(run.rlike("^[A-Za-z]+$"), limit_units(limits["letters"])).otherwise(limit_units(limits["mixed"]))
        allowed = F.lit(False)
        for pattern in allow:
            allowed = allowed | run.rlike(pattern)
        within = F.exists(base, lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"]))
        high = ~allowed & _high_window(run, most)
        if alphabets:
            rest, fits = run, F.lit(False)
            for pattern in allow:
                if pattern.startswith("^"):
                    fits = fits | run.rlike(pattern)
                else:
                    rest = F.regexp_replace(rest, pattern, _CUT)
            high = high | (~fits & _random_window(rest, alphabets))
        return ~within & high

    return F.filter(runs, secret)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", limits=LIMITS, allow=ALLOW, alphabets=None) -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) of every document; no shuffle."""
    t = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    t = t.withColumn("_base", base_spans(F.col("_t"))).withColumn("_more", entropy_spans(F.col("_t"), F.col("_base"), limits, allow, alphabets))
    n = lambda c, k: F.size(F.filter(c, lambda x: x["kind"] == k)).cast("long")
    return t.select(
        key, *[n(F.col("_base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.size("_more").cast("long").alias("n_entropy"),
        F.sha2(_written(F.col("_base")), 256).alias("base_sha256"), _written(F.concat("_base", "_more")).alias("spans"),
    )


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", limits=LIMITS, allow=ALLOW, alphabets=None) -> DataFrame:
    """The documents with every span masked (overlapping spans as one) and n_chars, if there, brought up to date."""
    names, size = docs.columns, "n_chars"
    t = docs.toDF(*[f"c{i}" for i in range(len(names))])
    c = F.col(f"c{names.index(text)}")
    whole = F.coalesce(c, F.lit(""))
    t = t.withColumn("_base", base_spans(whole)).withColumn("_more", entropy_spans(whole, F.col("_base"), limits, allow, alphabets))
    ordered = F.array_sort(F.transform(F.concat("_base", "_more"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    part = lambda a, b: F.substr(c, (a + 1).cast("int"), (b - a).cast("int"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["e"]).alias("at"),
        F.when(x["s"] >= acc["at"], F.concat(acc["out"], part(acc["at"], x["s"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
    )
    masked = F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], part(acc["at"], F.length(c).cast("long"))))
    t = t.withColumn("_masked", F.when(F.size(ordered) > 0, masked).otherwise(c))
    cols = []
    for i, name in enumerate(names):
        if name == text:
            cols.append(F.col("_masked").alias(name))
        elif name == size:
            cols.append(F.coalesce(F.length("_masked").cast(docs.schema[size].dataType), F.col(f"c{i}")).alias(name))
        else:
            cols.append(F.col(f"c{i}").alias(name))
    return t.select(*cols)
