"""Column functions: strict aggregates, null rules, class binning, units, codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from standlab import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- aggregates that turn null as soon as one input is null ---------------------------------

def _strict(agg, c) -> Column:
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def strict_sum(c) -> Column:
    return _strict(F.sum, c)


def strict_mean(c) -> Column:
    return _strict(F.avg, c)


def strict_min(c) -> Column:
    return _strict(F.min, c)


def strict_max(c) -> Column:
    return _strict(F.max, c)


def std_error(c) -> Column:
    """Sample standard deviation over the root of the row count (null rows count)."""
    return F.stddev_samp(_col(c)) / F.sqrt(F.count(F.lit(1)))


# -- null, NaN and bounds -------------------------------------------------------------------

def to_number(c) -> Column:
    """Text to double, null where the text is no number."""
    return _col(c).try_cast("double")


def is_finite(c) -> Column:
    c = _col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nan_to_null(c) -> Column:
    return F.when(~F.isnan(_col(c)), _col(c))


def ratio(num, den) -> Column:
    """Quotient, null on a zero or null divisor."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def clamp(c, low=None, high=None) -> Column:
    out = _col(c)
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


# -- classes --------------------------------------------------------------------------------

def bin_round(c, width: float) -> Column:
    """Nearest class mark: ``width * trunc((x + width/2) / width)``."""
    shifted = (_col(c) + width / 2.0) / width
    return F.lit(width) * shifted.cast("bigint")


def bin_cut(c, width: float, upper, right: bool = True) -> Column:
    """1-based class over breaks 0, width, 2*width ... up to the last full break below ``upper``.

    ``right=True`` closes classes on the right and takes 0 into the first;
    ``right=False`` closes them on the left.  Values beyond the last break give null.
    """
    x, n_breaks = _col(c), F.floor(_col(upper) / width)
    k = F.greatest(F.ceil(x / width), F.lit(1)) if right else F.floor(x / width) + 1
    return F.when((x >= 0) & (k <= n_breaks), k.cast("int"))


# -- codes and keys -------------------------------------------------------------------------

def plot_uid(block="block", plot="plot") -> Column:
    """Dotted plot id; undotted ids are ambiguous (``B2``+``11`` and ``B21``+``1``)."""
    return F.concat_ws(".", _col(block), _col(plot).cast("string"))


def key_part(c, sep: str, i: int) -> Column:
    return F.get(F.split(_col(c), f"[{sep}]"), F.lit(i))


def canonical_code(c) -> Column:
    """Treatment letters in alphabetical order, so ``WN`` and ``NW`` meet."""
    return F.array_join(F.array_sort(F.split(_col(c), "")), "")


def code_species(c, i: int) -> Column:
    """Species of the i-th letter of a treatment code, null where there is none."""
    letter = F.substring(_col(c), i, 1)
    return F.when(letter != "", F.concat(letter, F.lit("S")))


def stand_type(code) -> Column:
    return (F.when(_col(code).isin(K.MIXED), "Mixed")
            .when(_col(code).isin(K.PURE), "Monoculture"))


def level_order(c, levels: list[str]) -> Column:
    """1-based position in an ordered factor, null outside it."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), _col(c)), F.lit(0))


# -- units ----------------------------------------------------------------------------------

def inches_to_cm(c) -> Column:
    return _col(c) * K.CM_PER_IN


def cm_to_inches(c) -> Column:
    return _col(c) * K.IN_PER_CM


def inches_to_m(c) -> Column:
    return _col(c) * K.M_PER_IN


def feet_to_m(c) -> Column:
    return _col(c) * K.M_PER_FT


def feet_to_m_coarse(c) -> Column:
    return _col(c) / K.FT_PER_M


def m_to_feet(c) -> Column:
    return _col(c) * K.FT_PER_M


def per_acre_to_per_ha(c) -> Column:
    return _col(c) * K.ACRES_PER_HA


def basal_area_to_metric(c) -> Column:
    return _col(c) / K.FT2_AC_PER_M2_HA


# -- stand formulas -------------------------------------------------------------------------

def basal_area(dbh) -> Column:
    """Square feet of basal area of one stem."""
    return _col(dbh) * _col(dbh) * K.BASAL_AREA_FT2


def qmd(bapa, tpa) -> Column:
    """Quadratic mean diameter from basal area and stems per acre."""
    return F.sqrt(ratio(_col(bapa), _col(tpa) * K.BASAL_AREA_FT2))


def relative_density(bapa, qmd_) -> Column:
    """Curtis: basal area over the root of quadratic mean diameter."""
    return ratio(_col(bapa), F.sqrt(_col(qmd_)))


def stand_density_index(tpa, qmd_) -> Column:
    """Reineke: stems per acre scaled to a ten-inch mean diameter."""
    return _col(tpa) * F.pow(_col(qmd_) / 10.0, F.lit(1.605))


def relative_spacing(tpa, dominant_height) -> Column:
    """Mean distance between stems as a share of dominant height."""
    return ratio(F.sqrt(ratio(F.lit(K.SQFT_PER_ACRE), tpa)), dominant_height)


def crown_area(width) -> Column:
    return F.pow(_col(width) / 2.0, F.lit(2.0)) * F.pi()


def live_crown_ratio(height, base) -> Column:
    return ratio(_col(height) - _col(base), height)


def crown_base(height, crown_ratio) -> Column:
    return _col(height) - _col(crown_ratio) * _col(height)
