"""Great-circle geometry on latitude/longitude columns in degrees."""

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0
EARTH_RADIUS_M = 6371000.0


def _half_chord_squared(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d_lat = F.radians(lat2) - F.radians(lat1)
    d_lon = F.radians(lon2) - F.radians(lon1)
    return (F.pow(F.sin(d_lat / 2), 2.0)
            + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lon / 2), 2.0))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in km; NULL when a coordinate is NULL."""
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(_half_chord_squared(lat1, lon1, lat2, lon2)))


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres, in the atan2 form."""
    a = _half_chord_squared(lat1, lon1, lat2, lon2)
    return EARTH_RADIUS_M * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def signed_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, -180 to 180."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    d_lon = F.radians(lon2) - F.radians(lon1)
    east = F.sin(d_lon) * F.cos(phi2)
    north = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(d_lon)
    return F.degrees(F.atan2(east, north))


def compass_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    return F.pmod(signed_bearing(lat1, lon1, lat2, lon2) + 360.0, F.lit(360.0))


def angle_gap(a: Column, b: Column) -> Column:
    """Smallest difference between two angles in degrees."""
    gap = F.abs(a - b)
    return F.when(gap > 180, 360 - gap).otherwise(gap)
