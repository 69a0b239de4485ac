"""Doubles as text in the notation of manifests: shortest digits, fixed from 0.0001 up to below 1e16, else with an exponent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.geometry import bound


def text(x: Column) -> Column:
    """Like 10000000.0, 0.0001, 1e-05, 1.5e+300, -0.0: the fewest digits that give the double back, whatever the JVM prints."""
    # whole numbers that a long holds have their own digits; the JVM may round others of 17 digits twice
    whole = F.when((F.abs(x) >= 2.0**53) & (F.abs(x) < 9e18), F.concat(x.cast("bigint").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))
    mantissa, power = F.split_part(F.upper(F.regexp_replace(whole, "^-", "")), F.lit("E"), F.lit(1)), F.coalesce(F.nullif(F.split_part(F.upper(whole), F.lit("E"), F.lit(2)), F.lit("")).try_cast("int"), F.lit(0))
    units = F.split_part(mantissa, F.lit("."), F.lit(1))
    every = F.concat(units, F.split_part(mantissa, F.lit("."), F.lit(2)))
    digits = F.regexp_replace(every, "^0+", "")
    # the number is 0.DIGITS times ten to the power of `at`
    start = F.struct(digits.alias("digits"), (power + F.length(units) - (F.length(every) - F.length(digits))).alias("at"), F.abs(x).alias("x"))

    def shortest(s: Column) -> Column:
        def rounded(n: int) -> Column:
            kept = (F.rpad(s["digits"], 20, "0").cast("decimal(20,0)") / F.lit(str(10 ** (20 - n))).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")
            at = s["at"] + F.length(kept) - n
            return F.when((F.length(s["digits"]) > n) & (F.concat(F.lit("0."), kept, F.lit("E"), at.cast("string")).try_cast("double") == s["x"]), F.struct(F.regexp_replace(kept, "0+$", "").alias("digits"), at.alias("at")))

        # a double has 15 digits or, where those don't give it back, 16 or 17; next to 0 fewer may do
        small = F.when(s["x"] < 2.3e-308, F.coalesce(*[rounded(n) for n in range(1, 15)]))
        return F.coalesce(small, rounded(15), rounded(16), rounded(17), F.struct(F.regexp_replace(s["digits"], "0+$", "").alias("digits"), s["at"].alias("at")))

    def laid_out(s: Column) -> Column:
        d, at, n = s["digits"], s["at"], F.length(s["digits"])
        point = F.when(at >= n, F.concat(F.rpad(d, at, "0"), F.lit(".0"))).when(at > 0, F.concat(F.substr(d, F.lit(1), at), F.lit("."), F.substr(d, at + 1))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), d))
        shown = F.concat(F.substr(d, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(""))
        far = F.concat(shown, F.when(at - 1 < 0, "e-").otherwise("e+"), F.lpad(F.abs(at - 1).cast("string"), F.greatest(F.lit(2), F.length(F.abs(at - 1).cast("string"))), "0"))
        return F.when((at - 1 >= -4) & (at - 1 < 16), point).otherwise(far)

    sign = F.when(whole.startswith("-"), "-").otherwise("")
    plain = F.concat(sign, bound(bound(start, shortest), laid_out))
    return F.when(x == 0, F.concat(sign, F.lit("0.0"))).when(F.isnan(x) | (F.abs(x) == float("inf")), whole).otherwise(plain)
