"""Numeric Column expressions that stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

TINY = 1e-12

# Published double-precision coefficients, highest power first.
# Normal tail, |x| < 7.07 (Hart's rational form).
CDF_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376]
CDF_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
# Normal quantile (Wichura's AS 241): centre, shoulder, tail.
PPF_CENTRE_NUM = [2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
                  4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
                  1.3314166789178437745e2, 3.3871328727963666080]
PPF_CENTRE_DEN = [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
                  2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
                  4.2313330701600911252e1, 1.0]
PPF_SHOULDER_NUM = [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
                    1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550,
                    4.63033784615654529590, 1.42343711074968357734]
PPF_SHOULDER_DEN = [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
                    1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940,
                    2.05319162663775882187, 1.0]
PPF_TAIL_NUM = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
                2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580,
                5.46378491116411436990, 6.65790464350110377720]
PPF_TAIL_DEN = [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
                7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
                5.99832206555887937690e-1, 1.0]


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def safe_div(num, den) -> Column:
    """Division that yields NULL on a zero denominator (ANSI mode would raise)."""
    return F.try_divide(num, den)


def bounded(col, low: float, high: float) -> Column:
    """Clip, keeping NULL as NULL."""
    col = as_col(col)
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def at_least(col, low: float) -> Column:
    """Lower clip, keeping NULL as NULL (``greatest`` alone would return the bound)."""
    col = as_col(col)
    return F.when(col.isNotNull(), F.greatest(col, F.lit(low)))


def sigmoid(x) -> Column:
    x = as_col(x)
    return 1.0 / (1.0 + F.exp(-x))


def polynomial(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def let(value, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm_cdf(x) -> Column:
    """Standard normal distribution function to double precision."""
    def upper_tail(a):
        bell = F.exp(-a * a / 2.0)
        body = bell * polynomial(CDF_NUM, a) / polynomial(CDF_DEN, a)
        fraction = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))
        return F.when(a > 37.0, 0.0).when(a < 7.07106781186547, body).otherwise(bell / fraction / 2.506628274631)

    return let(as_col(x), lambda v: let(upper_tail(F.abs(v)), lambda t: F.when(v > 0, 1.0 - t).otherwise(t)))


def norm_ppf(p) -> Column:
    """Standard normal quantile to double precision; NULL outside (0, 1)."""
    ratio = lambda num, den, v: polynomial(num, v) / polynomial(den, v)
    centre = lambda q: q * ratio(PPF_CENTRE_NUM, PPF_CENTRE_DEN, 0.180625 - q * q)
    outer = lambda r: F.when(r <= 5.0, ratio(PPF_SHOULDER_NUM, PPF_SHOULDER_DEN, r - 1.6)).otherwise(
        ratio(PPF_TAIL_NUM, PPF_TAIL_DEN, r - 5.0))

    def inside(v):
        q = v - 0.5
        far = let(F.sqrt(-F.ln(F.least(v, 1.0 - v))), outer)
        return F.when(F.abs(q) <= 0.425, centre(q)).when(q < 0, -far).otherwise(far)

    return let(as_col(p), lambda v: F.when((v > 0) & (v < 1), inside(v)))


def safe_corr(x, y, over: WindowSpec | None = None) -> Column:
    """Pearson correlation over pairwise non-null values; NULL where a side is constant.

    ``corr`` itself raises on constant groups in ANSI mode.
    """
    x, y = as_col(x), as_col(y)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    run = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    sa, sb = run(F.stddev_pop(a)), run(F.stddev_pop(b))
    return F.when((sa > TINY) & (sb > TINY), run(F.covar_pop(a, b)) / (sa * sb))


def hash_uniform(*parts) -> Column:
    """Uniform in [0, 1) that depends only on the values, never on partitioning."""
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def inf_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace NaN and infinities by NULL in the given columns (NaN compares as larger than any number)."""
    return df.withColumns({c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in cols})
