"""Quaternions as tuples of four columns, order (1, i, j, k)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]


def col(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


def mul(p: Quat, *more: Quat) -> Quat:
    """Hamilton product, left to right."""
    for q in more:
        p = (
            p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3],
            p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2],
            p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1],
            p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0],
        )
    return p


def conj(q: Quat) -> Quat:
    return q[0], -q[1], -q[2], -q[3]


def euler(axis: int, angle) -> Quat:
    """Rotation by an angle about axis 0, 1 or 2."""
    if axis not in (0, 1, 2):
        raise ValueError(f"no such axis: {axis}")
    half = col(angle) / 2
    parts = [F.cos(half), F.lit(0.0), F.lit(0.0), F.lit(0.0)]
    parts[axis + 1] = F.sin(half)
    return tuple(parts)


def rotation_iso(theta, phi, psi=0.0) -> Quat:
    """Qz(phi) Qy(theta) Qz(psi), multiplied out."""
    theta, phi, psi = col(theta) / 2, col(phi) / 2, col(psi) / 2
    return F.cos(theta) * F.cos(phi + psi), F.sin(theta) * F.sin(psi - phi), F.sin(theta) * F.cos(psi - phi), F.cos(theta) * F.sin(phi + psi)


def rotation_lonlat(lon, lat, psi=0.0, azel: bool = False) -> Quat:
    lon = col(lon)
    return rotation_iso(F.lit(3.141592653589793 / 2) - col(lat), -lon if azel else lon, psi)


def rotation_xieta(xi, eta, gamma=0.0) -> Quat:
    """From offsets on the sky plane."""
    xi, eta = col(xi), col(eta)
    phi = F.atan2(-xi, -eta)
    return rotation_iso(F.asin(F.sqrt(xi * xi + eta * eta)), phi, col(gamma) - phi)


def decompose_iso(q: Quat) -> tuple[Column, Column, Column]:
    """theta, phi, psi."""
    a, b, c, d = q
    return 2 * F.atan2(F.sqrt(b * b + c * c), F.sqrt(a * a + d * d)), F.atan2(c * d - a * b, a * c + b * d), F.atan2(a * b + c * d, a * c - b * d)


def decompose_lonlat(q: Quat, azel: bool = False) -> tuple[Column, Column, Column]:
    """lon, lat, psi."""
    theta, phi, psi = decompose_iso(q)
    return (-phi if azel else phi), F.lit(3.141592653589793 / 2) - theta, psi


def decompose_xieta(q: Quat) -> tuple[Column, Column, Column]:
    """xi, eta, gamma."""
    a, b, c, d = q
    return 2 * (a * b - c * d), -2 * (a * c + b * d), F.atan2(2 * a * d, a * a - d * d)


def named(q: Quat, prefix: str = "q") -> list[Column]:
    return [c.alias(f"{prefix}{n}") for c, n in zip(q, "abcd")]


def read(prefix: str = "q") -> Quat:
    return tuple(F.col(f"{prefix}{n}") for n in "abcd")
