"""Planar and 3-D geometry as Column expressions, all JVM-side.

Frame: right-handed metres, +X right, +Y forward, +Z up; yaw turns left
(counter-clockwise). Vectors are structs (x, y, z), quaternions (x, y, z, w).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length below which a direction is undefined.
EPSILON = 1e-9


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it stands in it: what keeps composed poses small."""
    return F.get(F.transform(F.array(value), use), 0)


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def quat(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x, y, z, w), "xyzw", strict=True)])


def vec_add(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def vec_sub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def vec_scale(a: Column, k: Column) -> Column:
    return vec(a["x"] * k, a["y"] * k, a["z"] * k)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def almost_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.greatest(F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"]), F.abs(a["z"] - b["z"])) <= tolerance


def distance(a: Column, b: Column) -> Column:
    return norm(vec_sub(a, b))


def quat_norm(q: Column) -> Column:
    return F.sqrt(dot(q, q) + q["w"] * q["w"])


def quat_normalize(q: Column, least: float = 1e-12) -> Column:
    """Unit quaternion; one that is nearly zero raises."""
    n = quat_norm(q)
    n = F.when(n > least, n).otherwise(F.raise_error(F.lit("a zero quaternion has no direction")).cast("double"))
    return quat(q["x"] / n, q["y"] / n, q["z"] / n, q["w"] / n)


def quat_conjugate(q: Column) -> Column:
    return quat(-q["x"], -q["y"], -q["z"], q["w"])


def hamilton(a: Column, b: Column) -> Column:
    return quat(
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
    )


def quat_multiply(a: Column, b: Column) -> Column:
    """Hamilton product of unit length."""
    return bind(a, lambda p: bind(b, lambda q: bind(hamilton(p, q), quat_normalize)))


def quat_rotate(q: Column, v: Column) -> Column:
    """v turned by the unit quaternion q: v + 2w(u x v) + 2u x (u x v)."""
    tx = 2 * (q["y"] * v["z"] - q["z"] * v["y"])
    ty = 2 * (q["z"] * v["x"] - q["x"] * v["z"])
    tz = 2 * (q["x"] * v["y"] - q["y"] * v["x"])
    return vec(
        v["x"] + q["w"] * tx + q["y"] * tz - q["z"] * ty,
        v["y"] + q["w"] * ty + q["z"] * tx - q["x"] * tz,
        v["z"] + q["w"] * tz + q["x"] * ty - q["y"] * tx,
    )


def quat_angle_deg(a: Column, b: Column) -> Column:
    """Angle between two unit rotations, 0 to 180."""
    d = F.abs(dot(a, b) + a["w"] * b["w"])
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), d)))


def quat_matrix(q: Column) -> Column:
    """Rows of the 3x3 rotation matrix."""
    x, y, z, w = q["x"], q["y"], q["z"], q["w"]
    return F.array(
        F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        F.array(2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        F.array(2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def transform_apply(t: Column, p: Column) -> Column:
    """A transform is a struct (parent, child, translation, rotation)."""
    return bind(t, lambda u: bind(p, lambda v: vec_add(quat_rotate(u["rotation"], v), u["translation"])))


def transform_inverse(t: Column) -> Column:

    def turned(u: Column) -> Column:
        back = quat_conjugate(u["rotation"])
        moved = quat_rotate(back, vec_scale(u["translation"], F.lit(-1.0)))
        return F.struct(u["child"].alias("parent"), u["parent"].alias("child"), moved.alias("translation"), back.alias("rotation"))

    return bind(t, turned)


def transform_compose(a: Column, b: Column) -> Column:
    """a after b; a's child frame must be b's parent frame."""

    def both(p: Column, q: Column) -> Column:
        parent = F.when(p["child"] == q["parent"], p["parent"]).otherwise(F.raise_error(F.lit("frames do not meet")).cast("string"))
        return F.struct(parent.alias("parent"), q["child"].alias("child"), transform_apply(p, q["translation"]).alias("translation"), quat_multiply(p["rotation"], q["rotation"]).alias("rotation"))

    return bind(a, lambda p: bind(b, lambda q: both(p, q)))


def yaw_quaternion(yaw_rad: Column) -> Column:
    return quat(F.lit(0.0), F.lit(0.0), F.sin(yaw_rad / 2), F.cos(yaw_rad / 2))


def yaw_facing(from_x: Column, from_y: Column, to_x: Column, to_y: Column) -> Column:
    """Yaw whose forward axis points at the target; coincident points raise."""
    dx, dy = to_x - from_x, to_y - from_y
    fails = F.raise_error(F.lit("coincident points have no facing")).cast("double")
    return F.when(F.hypot(dx, dy) > EPSILON, F.atan2(-dx, dy)).otherwise(fails)


def facing_quaternion(from_x: Column, from_y: Column, to_x: Column, to_y: Column) -> Column:
    return yaw_quaternion(yaw_facing(from_x, from_y, to_x, to_y))


def clockwise_yaw_quaternion(yaw_deg: Column) -> Column:
    return yaw_quaternion(-F.radians(yaw_deg))


def yaw_pitch_quaternion(yaw_deg: Column, pitch_down_deg: Column) -> Column:
    """Yaw, then a pitch down about the turned right axis."""
    pitch = -F.radians(pitch_down_deg)
    return quat_multiply(yaw_quaternion(F.radians(yaw_deg)), quat(F.sin(pitch / 2), F.lit(0.0), F.lit(0.0), F.cos(pitch / 2)))


def optical_quaternion(agent: Column) -> Column:
    """Camera looking along forward instead of down: a quarter turn about the right axis first."""
    half = 0.5**0.5
    return quat_multiply(agent, quat(F.lit(half), F.lit(0.0), F.lit(0.0), F.lit(half)))


def yaw_of(q: Column) -> Column:
    """Yaw of a rotation, from all four components."""
    return F.atan2(2 * (q["w"] * q["z"] + q["x"] * q["y"]), 1 - 2 * (q["y"] * q["y"] + q["z"] * q["z"]))


def planar_yaw_of(q: Column) -> Column:
    """Yaw from z and w alone: another number than yaw_of() where the rotation has pitch."""
    return 2 * F.atan2(q["z"], q["w"])


def wrap_degrees(angle: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(angle + 180, F.lit(360.0)) - 180


def circular_delta(a: Column, b: Column) -> Column:
    return F.abs(wrap_degrees(a - b))


def angular_separation(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360 - d)


def camera_components(px: Column, py: Column, ox: Column, oy: Column, yaw: Column) -> tuple[Column, Column]:
    """(right, front) of a point seen from an origin with a yaw."""
    dx, dy = px - ox, py - oy
    return dx * F.cos(yaw) + dy * F.sin(yaw), -dx * F.sin(yaw) + dy * F.cos(yaw)


def planar_to_world(right: Column, front: Column, yaw: Column) -> tuple[Column, Column]:
    return right * F.cos(yaw) - front * F.sin(yaw), right * F.sin(yaw) + front * F.cos(yaw)


def yaw_half_extents(hx: Column, hy: Column, yaw: Column) -> tuple[Column, Column]:
    """Half extents, in a yaw frame, of an axis-aligned box."""
    c, s = F.abs(F.cos(yaw)), F.abs(F.sin(yaw))
    return c * hx + s * hy, s * hx + c * hy


#: (label, clockwise bearing of the sector's middle), in order of preference at ties.
SECTORS = (("front", 0.0), ("right", 90.0), ("back", 180.0), ("left", -90.0))


def obb_radius(ex: Column, ey: Column) -> Column:
    return 0.5 * F.hypot(ex, ey)


def bearing_deg(right: Column, front: Column) -> Column:
    """Clockwise from ahead."""
    return wrap_degrees(F.degrees(F.atan2(right, front)))


def direction(px: Column, py: Column, ox: Column, oy: Column, yaw: Column, radius: Column) -> Column:
    """struct(label, right_m, front_m, distance_m, bearing_deg, margin_deg, angular_radius_deg, effective_margin_deg)."""
    right, front = camera_components(px, py, ox, oy, yaw)
    far = F.hypot(right, front)
    bearing = bearing_deg(right, front)
    options = F.array(*[F.struct(circular_delta(bearing, F.lit(middle)).alias("off"), F.lit(i).alias("i"), F.lit(label).alias("label")) for i, (label, middle) in enumerate(SECTORS)])
    best = F.array_min(options)
    margin = 45 - best["off"]
    spread = F.when(far > EPSILON, F.degrees(F.atan2(F.greatest(radius, F.lit(0.0)), far))).otherwise(90.0)
    return F.struct(
        best["label"].alias("label"), right.alias("right_m"), front.alias("front_m"), far.alias("distance_m"), bearing.alias("bearing_deg"),
        margin.alias("margin_deg"), spread.alias("angular_radius_deg"), (margin - spread).alias("effective_margin_deg"),
    )


def dominant_relation(right: Column, front: Column) -> Column:
    """struct(relation, margin_m): the axis with the larger offset, left/right at a tie."""
    across = F.abs(right) >= F.abs(front)
    label = F.when(across, F.when(right > 0, "right_of").otherwise("left_of")).otherwise(F.when(front > 0, "in_front_of").otherwise("behind"))
    return F.struct(label.alias("relation"), F.greatest(F.abs(right), F.abs(front)).alias("margin_m"))


def is_dominant(a: Column, b: Column, ratio: float = 1.25) -> Column:
    """Whether the larger offset is enough larger, or the smaller is none."""
    low, high = F.least(F.abs(a), F.abs(b)), F.greatest(F.abs(a), F.abs(b))
    return (low == 0) | (high >= ratio * low)


def object_components(ox: Column, oy: Column, fx: Column, fy: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    """(right, front) of a target for one who stands at o and faces f; null if o and f coincide."""
    dx, dy = fx - ox, fy - oy
    # not hypot: its last bit decides the sign where the three are in one line
    n = F.sqrt(dx * dx + dy * dy)
    n = F.when(n >= 1e-6, n)
    ux, uy, vx, vy = dx / n, dy / n, tx - ox, ty - oy
    return vx * uy - vy * ux, vx * ux + vy * uy


def quadrant(right: Column, front: Column, joiner: str = "_") -> Column:
    return F.concat(F.when(front >= 0, "front").otherwise("back"), F.lit(joiner), F.when(right >= 0, "right").otherwise("left"))


def vertical_relation(az: Column, ah: Column, bz: Column, bh: Column, clearance: float = 0.1) -> Column:
    """'above', 'below' or null: a's box (centre z, half height) against b's with clearance between."""
    return F.when(az - ah - (bz + bh) >= clearance, "above").when(bz - bh - (az + ah) >= clearance, "below")


def gap(a: Column, ah: Column, b: Column, bh: Column) -> Column:
    return F.greatest(F.abs(a - b) - ah - bh, F.lit(0.0))


def aabb_clearance(a: Column, ah: Column, b: Column, bh: Column) -> Column:
    """Distance between two boxes given by centre and half extents."""
    return F.sqrt(sum((gap(a[k], ah[k], b[k], bh[k]) ** 2 for k in "xyz"), F.lit(0.0)))


def aabb_overlap(a: Column, ah: Column, b: Column, bh: Column, margin: float = 0.0) -> Column:
    """Overlap on all axes; a positive margin keeps boxes apart, a negative one lets them touch."""
    out = F.lit(True)
    for k in "xyz":
        out = out & (F.abs(a[k] - b[k]) < ah[k] + bh[k] + margin)
    return out


def obb_projection(half: Column, rotation: Column, ax: Column, ay: Column) -> Column:
    """Half length of a turned box along a unit direction in the plane."""
    m = quat_matrix(rotation)
    return sum((half[k] * F.abs(m[0][i] * ax + m[1][i] * ay) for i, k in enumerate("xyz")), F.lit(0.0))


def quantize(value: Column, step: float) -> Column:
    """Bin number, halves to even."""
    return F.rint(value / step).cast("bigint")


def aspect_distance(a: Column, b: Column) -> Column:
    """Largest difference of the centred logs of two size triples (arrays)."""

    def centred(v: Column) -> Column:
        logs = F.transform(v, lambda x: F.log(x))
        mean = F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / F.size(v)
        return F.transform(logs, lambda x: x - mean)

    return F.array_max(F.zip_with(centred(a), centred(b), lambda x, y: F.abs(x - y)))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 6)


def rotate_list(values: Column, offset: Column) -> Column:
    """The list begun at an offset, the rest after it."""
    n = F.size(values)
    k = F.when(n > 0, F.pmod(offset, n)).otherwise(0).cast("int")
    return F.when(n == 0, values).otherwise(F.concat(F.slice(values, k + 1, n), F.slice(values, F.lit(1), k)))


#: (phrase, clockwise bearing of the sector's middle); the first wins a tie.
BEARINGS = (
    ("ahead", 0.0), ("ahead right", 45.0), ("right", 90.0), ("behind right", 135.0),
    ("behind", 180.0), ("behind left", -135.0), ("left", -90.0), ("ahead left", -45.0),
)


def bearing_phrase(bearing: Column) -> Column:
    options = F.array(*[F.struct(circular_delta(bearing, F.lit(d)).alias("off"), F.lit(i).alias("i"), F.lit(p).alias("phrase")) for i, (p, d) in enumerate(BEARINGS)])
    return F.array_min(options)["phrase"]


def raster_cell(x: Column, y: Column, size: Column, metres: float = 0.01) -> tuple[Column, Column]:
    """(row, column) of a world point in a square raster with its origin in the middle."""
    half = size / 2
    return F.floor(half - y / metres).cast("int"), F.floor(x / metres + half).cast("int")


def view_relation(right: Column, front: Column) -> Column:
    """dominant_relation() of two objects in a view's frame with both offsets and the lead over the other axis, in 0.1 mm."""
    r = dominant_relation(right, front)
    to = lambda x: F.round(x, 4)
    lead = F.abs(F.abs(right) - F.abs(front))
    return F.struct(r["relation"].alias("relation"), to(right).alias("right_m"), to(front).alias("front_m"), to(r["margin_m"]).alias("dominant_m"), to(lead).alias("margin_m"))


def axis_relation(axis: Column, dx: Column, dy: Column) -> Column:
    """struct(relation, margin) along a declared axis ("x", else y); the margin is negative where the other axis leads."""
    across = axis == "x"
    label = F.when(across, F.when(dx > 0, "right_of").otherwise("left_of")).otherwise(F.when(dy > 0, "in_front_of").otherwise("behind"))
    lead = F.abs(dx) - F.abs(dy)
    return F.struct(label.alias("relation"), F.when(across, lead).otherwise(-lead).alias("margin_m"))


def object_anchored(right: Column, front: Column, half_right: Column, half_front: Column, least_deg: float = 20.0) -> Column:
    """struct(quadrant, angle_margin_deg, clear) of a target from object_components() and its half lengths on the two axes.

    Clear: the target lies wholly on one side of both axes and its bearing
    stays the least angle off them. Null where the frame has no heading.
    """
    off = F.degrees(F.least(F.atan2(F.abs(right), F.abs(front)), F.atan2(F.abs(front), F.abs(right))))
    clear = (off >= least_deg) & (F.abs(right) > half_right) & (F.abs(front) > half_front)
    return F.when(right.isNotNull(), F.struct(quadrant(right, front, "-").alias("quadrant"), F.round(off, 2).alias("angle_margin_deg"), clear.alias("clear")))
