"""Geometry of the unit sphere as column expressions: a vector is three columns."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS, TINY = 1e-12, 1e-10


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column


def vec(prefix: str = "", suffix: str = "") -> Vec:
    return Vec(*(F.col(f"{prefix}{c}{suffix}") for c in "xyz"))


def lit(x: float, y: float, z: float) -> Vec:
    return Vec(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))


def add(a: Vec, b: Vec) -> Vec:
    return Vec(*(p + q for p, q in zip(a, b)))


def sub(a: Vec, b: Vec) -> Vec:
    return Vec(*(p - q for p, q in zip(a, b)))


def scale(a: Vec, k) -> Vec:
    return Vec(*(p * k for p in a))


def dot(a: Vec, b: Vec) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Vec, b: Vec) -> Vec:
    return Vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normal(a: Vec, least: float = EPS) -> Vec:
    """The unit vector, or nulls for lengths up to `least` and for what is not finite."""
    n = length(a)
    ok = (n > least) & (n < float("inf"))
    return Vec(*(F.when(ok, p / n) for p in a))


def clamp(x: Column, low, high) -> Column:
    """x between low and high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def pick(condition: Column, a: Vec, b: Vec) -> Vec:
    if isinstance(a, Bound) or isinstance(b, Bound):
        return parts(F.when(condition, whole(a)).otherwise(whole(b)))
    return Vec(*(F.when(condition, p).otherwise(q) for p, q in zip(a, b)))


def tangent_part(u: Vec, f: Vec) -> Vec:
    """f without its part along the unit vector u."""
    return sub(f, scale(u, dot(u, f)))


def angle(a: Vec, b: Vec) -> Column:
    """Geodesic distance of unit vectors."""
    return F.atan2(length(cross(a, b)), clamp(dot(a, b), -1.0, 1.0))


def bind(value: Column, body) -> Column:
    """body(value) with value worked out once, so that nested formulas stay small."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Bound(Vec):
    """A vector whose components are fields of one struct column."""

    struct: Column


def parts(struct: Column) -> Vec:
    out = Bound(struct["x"], struct["y"], struct["z"])
    out.struct = struct
    return out


def whole(v: Vec) -> Column:
    """v as a struct; that which it comes from, if any, so that nested formulas hold it once and not once a component."""
    return v.struct if isinstance(v, Bound) else F.struct(*(c.alias(n) for c, n in zip(v, "xyz")))


def bind_vec(value: Column | Vec, body) -> Vec:
    """bind for a column or a vector, where body gives a vector."""
    many = isinstance(value, Vec)
    arg = whole(value) if many else value
    return parts(bind(arg, lambda v: whole(body(Vec(v["x"], v["y"], v["z"]) if many else v))))


def orthogonal(u: Vec, salt: Column | int) -> Vec:
    """A unit tangent at u chosen by an integer: the salt names an axis (the next one where u is near it) and, by its third bit, the sign."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    start = F.abs(salt) % 3
    axis = [F.element_at(F.array(*u), (start + i) % 3 + 1) for i in range(3)]
    near = [F.abs(a) > 0.85 for a in axis]
    choice = F.when(~near[0], start).when(~near[1], (start + 1) % 3).otherwise((start + 2) % 3)
    sign = F.when(salt.bitwiseAND(F.lit(4)) != 0, -1.0).otherwise(1.0)

    def side(k):
        zero = F.lit(0.0)
        t = Vec(F.when(k == 0, zero).when(k == 1, -u.z).otherwise(u.y), F.when(k == 0, u.z).when(k == 1, zero).otherwise(-u.x), F.when(k == 0, -u.y).when(k == 1, u.x).otherwise(zero))
        return bind_vec(t, lambda v: bind_vec(sign / length(v), lambda n: scale(v, n)))

    return bind_vec(choice, side)


def direction(a: Vec, b: Vec, salt: Column | int = 0) -> Vec:
    """The unit tangent at a towards b, or orthogonal() where there is none."""
    def unit(t):
        return bind_vec(length(t), lambda n: pick(n > TINY, scale(t, 1 / n), orthogonal(a, salt)))

    return bind_vec(tangent_part(a, b), unit)


def exp_map(u: Vec, step: Vec) -> Vec:
    """From u along the tangent part of step, as far as it is long."""
    def body(t):
        return bind_vec(length(t), lambda n: bind_vec(pick(n < 1e-8, add(u, t), add(scale(u, F.cos(n)), scale(t, F.sin(n) / n))), normal))

    return bind_vec(tangent_part(u, step), body)


def along(u: Vec, tangent: Vec, far) -> Vec:
    """From u along a unit tangent by an angle."""
    return add(scale(u, F.cos(far)), scale(tangent, F.sin(far)))


def cone(p: Vec, anchor: Vec, most, salt: Column | int = 0) -> Vec:
    """p, pulled back to the angle `most` around anchor if it is farther."""
    most = F.lit(float(most)) if not isinstance(most, Column) else most
    moved = bind_vec(direction(anchor, p, salt), lambda t: along(anchor, t, most))
    return bind_vec(angle(anchor, p), lambda d: pick((d <= most) | (d <= TINY), p, pick(most == 0, anchor, moved)))


def from_degrees(lon: Column, lat: Column) -> Vec:
    """Longitude and latitude to a unit vector; y is up."""
    a, b = F.radians(lon), F.radians(lat)
    return Vec(F.cos(b) * F.cos(a), F.sin(b), F.cos(b) * F.sin(a))


def slerp(a: Vec, b: Vec, t: Column | float, salt: Column | int = 0) -> Vec:
    """Along the great circle from a to b; nearly equal ends go straight, opposite ones through orthogonal(a, salt)."""
    t = clamp(F.lit(float(t)) if not isinstance(t, Column) else t, 0.0, 1.0)
    straight = normal(add(scale(a, 1 - t), scale(b, t)))
    turn = add(scale(a, F.cos(math.pi * t)), scale(orthogonal(a, salt), F.sin(math.pi * t)))

    def body(d):
        arc = add(scale(a, F.sin((1 - t) * d) / F.sin(d)), scale(b, F.sin(t * d) / F.sin(d)))
        return pick(d < 1e-7, straight, pick(F.lit(math.pi) - d < 1e-7, turn, arc))

    return bind_vec(angle(a, b), body)


def arc_segments(d: Column) -> Column:
    """Segments of an arc of this angle: one each 7.5 degrees, 2 to 32."""
    return F.greatest(F.lit(2), F.least(F.lit(32), F.ceil(d / (math.pi / 24)).cast("int")))


def edge_segments(n: Column) -> Column:
    """Segments an edge when there are n edges: 180000 in all, 2 to 32."""
    return F.when(n > 0, F.greatest(F.lit(2), F.least(F.lit(32), F.floor(180_000 / n).cast("int")))).otherwise(32)


def degree_scale(degree: Column, globe: float = 100.0, base: float = 1.0) -> Column:
    """Marker size: base * 100 / globe, grown by up to 1.25 with the logarithm of the degree."""
    return F.lit(base * 100.0 / globe) * (1 + F.least(F.lit(1.25), F.log2(degree + 1) * 0.22))


def collision_radius(size: Column, radius: float = 100.0, lift: float = 0.4) -> Column:
    return F.atan2(size * 1.12, F.lit(radius + lift))


def globe_size(n: Column) -> Column:
    """clamp(100 (n / 100)^.25 to the next 5, 60, 400)."""
    return F.least(F.lit(400), F.greatest(F.lit(60), (F.floor(100 * F.pow(n / 100, F.lit(0.25)) / 5 + 0.5) * 5).cast("int")))


def smoothstep(t: Column) -> Column:
    t = clamp(t, 0.0, 1.0)
    return t * t * (3 - 2 * t)


def vertical_fov(aspect: Column) -> Column:
    """Degrees: 45 for wide views, else 2 atan(tan 26° / aspect), at most 85, which an aspect of 0 has too."""
    return F.when(aspect >= 1, 45.0).when(aspect == 0, 85.0).otherwise(F.least(F.lit(85.0), F.degrees(2 * F.atan(F.tan(F.radians(F.lit(26.0))) / aspect))))


def rotation_step(ms: Column) -> Column:
    return F.least(F.lit(64.0), ms) / 1000 * 0.07


def compact_kernel(d: Column, s) -> Column:
    """(1 - d²/s²)³ inside the support s, else 0."""
    q = 1 - d * d / (s * s)
    return F.when(q > 0, q * q * q).otherwise(0.0)


def occluded(camera: Vec, point: Vec, radius: float) -> Column:
    """The segment from camera to point meets the globe strictly between its ends."""
    d = sub(point, camera)
    a, b, c = dot(d, d), 2 * dot(camera, d), dot(camera, camera) - radius * radius
    disc = b * b - 4 * a * c
    near = (-b - F.sqrt(F.greatest(F.lit(0.0), disc))) / (2 * a)
    return (a > 0) & (disc >= 0) & (near > 1e-6) & (near < 1 - 1e-6)


def fibonacci(i: Column, n: Column) -> Vec:
    """The i-th of n points of a Fibonacci sphere, y from 1 down to -1."""
    y = 1 - 2 * (i + 0.5) / n
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    a = i * (math.pi * (3 - math.sqrt(5)))
    return normal(Vec(F.cos(a) * r, y, F.sin(a) * r))
