"""Identities of prefixes and slices of a sequence, and periods from them: polynomial sums over a window.

The j-th value of an episode counts x(j) * B ** j modulo a prime, so the sum up to a row stands for the whole sequence up to it,
and a slice is a difference of two sums: equal slices at other places differ by a power of B. All is one window per
episode; a row keeps two numbers however long the episode is, where arrays of all earlier values would be quadratic. Two
primes of 31 bits each tell slices apart (a pair of other slices is taken for equal with probability of about 2 ** -62 times their length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.trajectory import episode

#: (prime, base) of the two sums.
MODULI = ((2147483647, 911382323), (2147483629, 972663749))
#: Powers of a base are products of three table entries, so exponents go up to 1024 ** 3.
_STEP = 1024


def _powers(base: int, prime: int, count: int = _STEP) -> Column:
    out, x = [], 1
    for _ in range(count):
        out.append(f"{x}L")
        x = x * base % prime
    return F.expr(f"array({', '.join(out)})")


def power(exponent: Column, base: int, prime: int) -> Column:
    """base ** exponent modulo prime."""
    e = exponent.cast("long")
    digit = lambda k: F.try_element_at(_powers(pow(base, _STEP**k, prime), prime), (F.shiftright(e, 10 * k).bitwiseAND(F.lit(_STEP - 1)) + 1).cast("int"))
    return digit(0) * digit(1) % prime * digit(2) % prime


def _terms(value: Column, place: Column) -> list[Column]:
    """x * B ** place of a value for each modulus; null is a value of its own."""
    codes = [F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit("\x00null")), F.lit(k)), F.lit(p)) for k, (p, _) in enumerate(MODULI)]
    return [c * power(place, b, p) % p for c, (p, b) in zip(codes, MODULI, strict=True)]


def packed(sums: list[Column]) -> Column:
    """One long of the two sums modulo their primes."""
    a, b = (F.pmod(s, F.lit(p)) for s, (p, _) in zip(sums, MODULI, strict=True))
    return F.shiftleft(a, 31).bitwiseOR(b)


def with_prefix_ids(df: DataFrame, column: str, prefix: str = "prefix") -> DataFrame:
    """<prefix>_len and <prefix>_id of the values of column on all rows before this one; equal prefixes have equal pairs.

    The pair of the empty prefix is (0, 0). Rows must have distinct turns within an episode; turns may have gaps.
    """
    place = F.row_number().over(episode()) - 1
    before = episode().rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_place", place.cast("long"))
    first, second = _terms(F.col(column), F.col("_place"))
    rows = rows.withColumns({"_t1": first, "_t2": second})
    sums = [F.coalesce(F.sum(t).over(before), F.lit(0).cast("long")) for t in ("_t1", "_t2")]
    return rows.withColumns({f"{prefix}_len": F.col("_place"), f"{prefix}_id": packed(sums)}).drop("_place", "_t1", "_t2")


def shared_prefixes(df: DataFrame, column: str) -> DataFrame:
    """episode, shared: the longest prefix of each episode, whole episodes included, that another episode has too.

    One row per prefix is counted by its identity; no two episodes are ever compared.
    """
    whole = df.groupBy("episode").agg(F.max("turn").alias("_last"))
    closed = df.select("episode", "turn", column).unionByName(whole.select("episode", (F.col("_last") + 1).alias("turn"), F.lit(None).cast(dict(df.dtypes)[column]).alias(column)))
    ids = with_prefix_ids(closed, column).select("episode", "prefix_len", "prefix_id")
    of = ids.where("prefix_len > 0").groupBy("prefix_len", "prefix_id").agg(F.count(F.lit(1)).alias("n"), F.min("episode").alias("first")).where("n > 1")
    met = ids.join(of.select("prefix_len", "prefix_id"), ["prefix_len", "prefix_id"], "left_semi").groupBy("episode").agg(F.max("prefix_len").alias("shared"))
    return whole.select("episode").join(met, "episode", "left").select("episode", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))


def repeated_slices(df: DataFrame, column: str, length: int) -> DataFrame:
    """episode, turn, first_turn: rows that end a slice of so many values which ended earlier in the episode too, and where it first did."""
    rows = df.withColumn("_place", (F.row_number().over(episode()) - 1).cast("long"))
    first, second = _terms(F.col(column), F.col("_place"))
    near = episode().rowsBetween(1 - length, 0)
    rows = rows.withColumns({"_t1": first, "_t2": second})
    sums = [F.sum(t).over(near) for t in ("_t1", "_t2")]
    # moved back to place 0 by the inverse power of where the slice begins
    begin = F.col("_place") - (length - 1)
    rows = rows.withColumns({"_s1": sums[0], "_s2": sums[1]}).where(begin >= 0)
    moved = [F.pmod(F.col(f"_s{k + 1}"), F.lit(p)) * power(begin, pow(b, -1, p), p) % p for k, (p, b) in enumerate(MODULI)]
    rows = rows.withColumn("_id", packed(moved)).withColumn("first_turn", F.min("turn").over(Window.partitionBy("episode", "_id")))
    return rows.where("first_turn < turn").select("episode", "turn", "first_turn")


def with_periods(df: DataFrame, max_period: int = 64, history: int = 128) -> DataFrame:
    """period: the smallest p >= 2 with the last p positions of the spell equal to the p before, on two places or more; else null.

    Each p is a comparison of two sums, so a row costs as much as its history is long, and no slice is made.
    """
    spell = Window.partitionBy("episode", "life", "spell", "progress").orderBy("turn")
    rows = df.withColumn("_place", (F.row_number().over(spell) - 1).cast("long"))
    first, second = _terms(F.col("pos"), F.col("_place"))
    rows = rows.withColumns({"_t1": F.when(~F.col("progress"), first), "_t2": F.when(~F.col("progress"), second)})
    upto = spell.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_i1": F.sum("_t1").over(upto), "_i2": F.sum("_t2").over(upto)})
    # _h: the sums before each of the last rows, oldest first, this one's last
    before = F.struct((F.col("_i1") - F.col("_t1")).alias("a"), (F.col("_i2") - F.col("_t2")).alias("b"))
    rows = rows.withColumn("_e", F.when(~F.col("progress"), before))
    rows = rows.withColumn("_h", F.collect_list("_e").over(spell.rowsBetween(1 - history, 0)))
    n = F.size("_h")
    at = lambda back: F.try_element_at("_h", (n - back + 1).cast("int"))  # noqa: E731  the sums before the last `back` rows
    pows = [_powers(b, p, max_period + 1) for p, b in MODULI]

    def same(ahead: list[Column], behind: list[Column], shift: Column) -> Column:
        """Two slices, given as differences of sums, the first so many places after the second."""
        ok = F.lit(True)
        for x, y, (p, _), table in zip(ahead, behind, MODULI, pows, strict=True):
            ok = ok & (F.pmod(x, F.lit(p)) == F.pmod(y, F.lit(p)) * F.try_element_at(table, (shift + 1).cast("int")) % p)
        return ok

    def repeats(p: Column) -> Column:
        mid, far, second = at(p), at(2 * p), at(p - 1)
        twice = same([F.col("_i1") - mid["a"], F.col("_i2") - mid["b"]], [mid["a"] - far["a"], mid["b"] - far["b"]], p)
        last = F.try_element_at("_h", F.lit(-1))  # the sums before this row
        # all of the last p are one place if the slice without its first equals that without its last
        one_place = same([F.col("_i1") - second["a"], F.col("_i2") - second["b"]], [last["a"] - mid["a"], last["b"] - mid["b"]], F.lit(1))
        return twice & ~one_place

    periods = F.filter(F.sequence(F.lit(2), F.least(F.lit(max_period), F.expr("size(_h) div 2"))), repeats)
    found = F.when(~F.col("progress") & (n >= 4), F.try_element_at(periods, F.lit(1))).cast("long")
    return rows.withColumn("period", found).drop("_place", "_t1", "_t2", "_i1", "_i2", "_e", "_h")
