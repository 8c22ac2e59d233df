"""Density of sea water from temperature and salinity as column expressions.

The chain is: absolute salinity from practical salinity by the reference composition (the regional anomaly
atlas is left out, so it is too low by up to 0.02 g/kg in some oceans); potential temperature by the published starting polynomial
(its error at 600 m is a few thousandths of a degree); conservative temperature from potential enthalpy;
density from the 75-term polynomial of specific volume (Roquet and others, 2015) at the reference pressure. Negative
salinities count as 0. Everything stays in one expression, within code generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPS = 35.16504 / 35.0
# Coefficients v[s, t, p] of specific volume in scaled root salinity, temperature and pressure.
SPECIFIC_VOLUME = {
    "000": 1.0769995862e-3, "001": -6.0799143809e-5, "002": 9.9856169219e-6, "003": -1.1309361437e-6, "004": 1.0531153080e-7, "005": -1.2647261286e-8, "006": 1.9613503930e-9,
    "010": -1.5649734675e-5, "011": 1.8505765429e-5, "012": -1.1736386731e-6, "013": -3.6527006553e-7, "014": 3.1454099902e-7,
    "020": 2.7762106484e-5, "021": -1.1716606853e-5, "022": 2.1305028740e-6, "023": 2.8695905159e-7,
    "030": -1.6521159259e-5, "031": 7.9279656173e-6, "032": -4.6132540037e-7,
    "040": 6.9111322702e-6, "041": -3.4102187482e-6, "042": -6.3352916514e-8,
    "050": -8.0539615540e-7, "051": 5.0736766814e-7, "060": 2.0543094268e-7,
    "100": -3.1038981976e-4, "101": 2.4262468747e-5, "102": -5.8484432984e-7, "103": 3.6310188515e-7, "104": -1.1147125423e-7,
    "110": 3.5009599764e-5, "111": -9.5677088156e-6, "112": -5.5699154557e-6, "113": -2.7295696237e-7,
    "120": -3.7435842344e-5, "121": -2.3678308361e-7, "122": 3.9137387080e-7,
    "130": 2.4141479483e-5, "131": -3.4558773655e-6, "132": 7.7618888092e-9,
    "140": -8.7595873154e-6, "141": 1.2956717783e-6, "150": -3.3052758900e-7,
    "200": 6.6928067038e-4, "201": -3.4792460974e-5, "202": -4.8122251597e-6, "203": 1.6746303780e-8,
    "210": -4.3592678561e-5, "211": 1.1100834765e-5, "212": 5.4620748834e-6,
    "220": 3.5907822760e-5, "221": 2.9283346295e-6, "222": -6.5731104067e-7,
    "230": -1.4353633048e-5, "231": 3.1655306078e-7, "240": 4.3703680598e-6,
    "300": -8.5047933937e-4, "301": 3.7470777305e-5, "302": 4.9263106998e-6,
    "310": 3.4532461828e-5, "311": -9.8447117844e-6, "312": -1.3544185627e-6,
    "320": -1.8698584187e-5, "321": -4.8826139200e-7, "330": 2.2863324556e-6,
    "400": 5.8086069943e-4, "401": -1.7322218612e-5, "402": -1.7811974727e-6,
    "410": -1.1959409788e-5, "411": 2.5909225260e-6, "420": 3.8595339244e-6,
    "500": -2.1092370507e-4, "501": 3.0927427253e-6, "510": 1.3864594581e-6, "600": 3.1932457305e-5,
}
# Coefficients h[x, y] of potential enthalpy in root salinity (x) and temperature (y), both scaled.
POTENTIAL_ENTHALPY = {
    "00": 61.01362420681071, "01": 168776.46138048015, "02": -2735.2785605119625, "03": 2574.2164453821433, "04": -1536.6644434977543, "05": 545.7340497931629, "06": -50.91091728474331, "07": -18.30489878927802,
    "20": 268.5520265845071, "21": -12019.028203559312, "22": 3734.858026725145, "23": -2046.7671145057618, "24": 465.28655623826234, "25": -0.6370820302376359, "26": -10.650848542359153,
    "30": 937.2099110620707, "31": 588.1802812170108, "32": 248.39476522971285, "33": -3.871557904936333, "34": -2.6268019854268356,
    "40": -1687.914374187449, "41": 936.3206544460336, "42": -942.7827304544439, "43": 369.4389437509002, "44": -33.83664947895248, "45": -9.987880382780322,
    "50": 246.9598888781377, "60": 123.59576582457964, "70": -48.5891069025409,
}
# Coefficients of the potential temperature's first estimate: 1, salinity, pressure, then with temperature.
THETA = (8.65483913395442e-6, -1.41636299744881e-6, -7.38286467135737e-9, -8.38241357039698e-6, 2.83933368585534e-8, 1.77803965218656e-8, 1.71155619208233e-10)
HEAT_CAPACITY = 3991.86795711963
SALINITY_SCALE, SALINITY_OFFSET = 0.0248826675584615, 0.5971840214030754


def _polynomial(coefficients: dict[str, float], *xs: str) -> str:
    """Nested (Horner) SQL of a polynomial whose keys are the powers of xs."""
    if not xs:
        return repr(coefficients[""]) + "D"
    powers = sorted({int(k[0]) for k in coefficients}, reverse=True)
    out, last = "", None
    for p in range(powers[0], -1, -1):
        part = {k[1:]: v for k, v in coefficients.items() if int(k[0]) == p}
        inner = _polynomial(part, *xs[1:]) if part else "0.0D"
        out = inner if last is None else f"({inner} + {xs[0]} * {out})"
        last = p
    return out


def absolute_salinity(salinity: str) -> str:
    return f"({salinity} * {UPS!r}D)"


def potential_temperature(salinity: str, temperature: str, pressure: str) -> str:
    a, b, c, d, e, f, g = (repr(x) + "D" for x in THETA)
    s1 = f"({salinity} / {UPS!r}D)"
    return f"({temperature} + {pressure} * ({a} + {s1} * {b} + {pressure} * {c} + {temperature} * ({d} + {s1} * {e} + {temperature} * {f} + {pressure} * {g})))"


def conservative_temperature(salinity: str, theta: str) -> str:
    x, y = f"sqrt({SALINITY_SCALE!r}D * {salinity})", f"({theta} * 0.025D)"
    return f"({_polynomial(POTENTIAL_ENTHALPY, x, y)} / {HEAT_CAPACITY!r}D)"


def density_of(salinity: str, conservative: str, pressure: str) -> str:
    """kg/m3 of absolute salinity, conservative temperature and pressure in dbar."""
    xs = f"sqrt({SALINITY_SCALE!r}D * {salinity} + {SALINITY_OFFSET!r}D)"
    return f"(1.0D / {_polynomial(SPECIFIC_VOLUME, xs, f'({conservative} * 0.025D)', f'({pressure} * 1e-4D)')})"


def with_potential_density(df: DataFrame, salinity: str, temperature: str, depth: str, name: str = "density") -> DataFrame:
    """df with the potential density; intermediate columns keep each expression short and are dropped."""
    both = F.col(salinity).isNotNull() & F.col(temperature).isNotNull()
    out = df.withColumn("_sa", F.when(both, F.greatest(F.expr(absolute_salinity(salinity)), F.lit(0.0))))
    out = out.withColumn("_ct", F.expr(conservative_temperature("_sa", potential_temperature("_sa", temperature, depth))))
    return out.withColumn(name, F.expr(density_of("_sa", "_ct", "0.0D"))).drop("_sa", "_ct")

