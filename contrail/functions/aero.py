"""Distances, standard atmosphere, speeds and flight regimes, as column expressions.

Speeds follow the public equations of the International Standard Atmosphere for a perfect gas: temperature and pressure
by height, Mach number from true airspeed, and calibrated airspeed from impact pressure.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors.
KT_MS, FT_M, FPM_MS = 0.514444, 0.3048, 0.00508
M_FT, MS_KT, MS_FPM, KM_NM, EARTH_KM = 3.28084, 1.94384, 196.850394, 1.852, 6371.0
# Sea level state, lapse rate and gas constants of the standard atmosphere.
T0, P0, LAPSE, TROPOPAUSE_M, T_STRATO, G, R, GAMMA = 288.15, 101325.0, 0.0065, 11000.0, 216.65, 9.80665, 287.05287, 1.4
A0 = math.sqrt(GAMMA * R * T0)
CROSSOVER_FT, FIRST_TAS_KT = 28000.0, 250.0

Col = Column | str


def _c(x: Col | float | None) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x).cast("double")


def clip(x: Column, lo: float, hi: float) -> Column:
    """x within [lo, hi], null for null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def haversine_km(lat1: Col, lon1: Col, lat2: Col, lon2: Col) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat, dlon = p2 - p1, F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(clip(a, 0.0, 1.0)))


def isa_temperature(h_m: Col) -> Column:
    h = _c(h_m)
    return F.when(h > TROPOPAUSE_M, F.lit(T_STRATO)).when(h.isNotNull(), F.lit(T0) - LAPSE * h)


def isa_pressure(h_m: Col) -> Column:
    h = _c(h_m)
    at = P0 * (T_STRATO / T0) ** (G / (R * LAPSE))
    low = P0 * F.pow(1 - LAPSE * F.least(h, F.lit(TROPOPAUSE_M)) / T0, F.lit(G / (R * LAPSE)))
    return F.when(h > TROPOPAUSE_M, at * F.exp(-G / (R * T_STRATO) * (h - TROPOPAUSE_M))).when(h.isNotNull(), low)


def _sound(temp_k: Column) -> Column:
    return F.sqrt(F.lit(GAMMA * R) * temp_k)


def mach_to_tas_kt(mach: Col, h_m: Col, temp_k: Col | None = None) -> Column:
    """True airspeed of a Mach number; at the standard temperature if none is given."""
    return _c(mach) * _sound(isa_temperature(h_m) if temp_k is None else _c(temp_k)) / KT_MS


def _mach_of_impact(q_over_p: Column) -> Column:
    return F.sqrt(F.lit(5.0) * (F.pow(q_over_p + 1, F.lit(2 / 7)) - 1))


def cas_to_tas_kt(cas_kt: Col, h_m: Col, temp_k: Col | None = None) -> Column:
    """True airspeed of a calibrated airspeed."""
    q = P0 * (F.pow(1 + 0.2 * F.pow(_c(cas_kt) * KT_MS / A0, F.lit(2.0)), F.lit(3.5)) - 1)
    return _mach_of_impact(q / isa_pressure(h_m)) * _sound(isa_temperature(h_m) if temp_k is None else _c(temp_k)) / KT_MS


def tas_to_cas_kt(tas_kt: Col, h_m: Col) -> Column:
    """Calibrated airspeed of a true airspeed."""
    mach = _c(tas_kt) * KT_MS / _sound(isa_temperature(h_m))
    q = isa_pressure(h_m) * (F.pow(1 + 0.2 * mach * mach, F.lit(3.5)) - 1)
    return A0 * _mach_of_impact(q / P0) / KT_MS


def mach_to_cas_kt(mach: Col, h_m: Col) -> Column:
    return tas_to_cas_kt(mach_to_tas_kt(mach, h_m), h_m)


def tas_target_kt(mach: Col, cas_kt: Col, alt_ft: Col) -> Column:
    """True airspeed of the Mach command if there is one, else of the CAS command."""
    h = _c(alt_ft) * FT_M
    return F.when(_c(mach).isNotNull(), mach_to_tas_kt(mach, h)).otherwise(cas_to_tas_kt(cas_kt, h))


def tas_intent_kt(mach: Col, cas_kt: Col, alt_ft: Col, temp_k: Col | None = None) -> Column:
    """The smaller of the true airspeeds of both commands, or the one there is."""
    h = _c(alt_ft) * FT_M
    return F.least(mach_to_tas_kt(mach, h, temp_k), cas_to_tas_kt(cas_kt, h, temp_k))


def gamma_rad(rate_fpm: Col, tas_kt: Col) -> Column:
    """Flight path angle where the airspeed is positive, else null."""
    tas = _c(tas_kt)
    return F.when(tas > 0, F.asin(clip(_c(rate_fpm) * FPM_MS / (tas * KT_MS), -1.0, 1.0)))


def flight_path_angle_deg(rate_fpm: Col, tas_kt: Col) -> Column:
    """Flight path angle with the airspeed taken as 1 m/s at least."""
    tas = F.when(_c(tas_kt).isNotNull(), F.greatest(_c(tas_kt) * KT_MS, F.lit(1.0)))
    return F.degrees(F.asin(clip(_c(rate_fpm) * FPM_MS / tas, -1.0, 1.0)))


def high_regime(alt_ft: Col, phase: Col, up_ft: Col | float = CROSSOVER_FT, down_ft: Col | float | None = None) -> Column:
    """True where Mach is flown: at or above the upper crossover, and between the two except in climb."""
    alt, up = _c(alt_ft), _c(up_ft)
    down = up if down_ft is None else _c(down_ft)
    ph = F.coalesce(F.upper(_c(phase)), F.lit("LEVEL"))
    return F.when(alt.isNull(), False).when(alt >= up, True).when(alt <= down, False).otherwise(ph.isin("LEVEL", "DESCENT"))


def tas_by_regime_kt(mach: Col, cas_kt: Col, alt_ft: Col, high: Column) -> Column:
    """True airspeed of the command of the regime, else of the other."""
    h = _c(alt_ft) * FT_M
    m, c = mach_to_tas_kt(mach, h), cas_to_tas_kt(cas_kt, h)
    return F.when(high, F.coalesce(m, c)).otherwise(F.coalesce(c, m))


def distance_tas_kt(mach: Col, cas_kt: Col, alt_ft: Col, phase: Col, level_mach: Col | float | None = None) -> Column:
    """True airspeed for adding up distance: CAS in climb, Mach then CAS when level, CAS then Mach in descent; failing
    that, whichever command there is."""
    h, ph, lm = _c(alt_ft) * FT_M, F.upper(_c(phase)), _c(level_mach)
    m, c, level = mach_to_tas_kt(mach, h), cas_to_tas_kt(cas_kt, h), mach_to_tas_kt(lm, h)
    own = F.when(ph == "CLIMB", c).when(ph == "LEVEL", F.coalesce(level, m, c)).otherwise(F.coalesce(c, m, level))
    return F.coalesce(own, tas_target_kt(mach, cas_kt, alt_ft))


def temperature_k(observed: Column, alt_ft: Col) -> Column:
    """Observed temperature, in Celsius where below 150, else of the standard atmosphere (null height: sea level)."""
    return F.coalesce(F.when(observed < 150, observed + 273.15).otherwise(observed), isa_temperature(F.coalesce(_c(alt_ft), F.lit(0.0)) * FT_M))


def heading_rad(deg: Column) -> Column:
    return F.pmod(deg * (math.pi / 180.0), F.lit(2.0 * math.pi))


def ground_speed_kt(tas_kt: Col, headwind_kt: Col | float = 0.0) -> Column:
    return _c(tas_kt) - _c(headwind_kt)


def cas_after_transition(cas_kt: Col, prev: Col, new: Col, lo: float = 130.0, hi: float = 340.0) -> Column:
    return clip(_c(cas_kt) + (_c(new) - _c(prev)), lo, hi)
