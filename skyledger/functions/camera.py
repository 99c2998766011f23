"""Camera geometry as column expressions; quaternions are (w, x, y, z) unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Vec = tuple[Column, Column, Column]


def rotation(qw, qx, qy, qz) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion, as rows."""
    return [
        [1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy - qz * qw), 2 * (qx * qz + qy * qw)],
        [2 * (qx * qy + qz * qw), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz - qx * qw)],
        [2 * (qx * qz - qy * qw), 2 * (qy * qz + qx * qw), 1 - 2 * (qx * qx + qy * qy)],
    ]


def transpose(m):
    return [[m[j][i] for j in range(len(m))] for i in range(len(m[0]))]


def times(m, v) -> list[Column]:
    """Matrix times vector."""
    out = []
    for row in m:
        total = row[0] * v[0]
        for a, b in zip(row[1:], v[1:]):
            total = total + a * b
        out.append(total)
    return out


def product(a, b) -> list[list[Column]]:
    return transpose([times(a, column) for column in transpose(b)])


def camera_centre(qw, qx, qy, qz, tx, ty, tz) -> list[Column]:
    """World position of a world-to-camera pose."""
    return [-c for c in times(transpose(rotation(qw, qx, qy, qz)), [tx, ty, tz])]


def quaternion(m) -> list[Column]:
    """(w, x, y, z) of a rotation matrix with w >= 0.

    Four times the outer product of a unit quaternion is linear in the matrix entries; its
    column with the largest diagonal entry, rescaled, is the quaternion.
    """
    x, y, z = m[0][0], m[1][1], m[2][2]
    diagonal = [1 + x + y + z, 1 + x - y - z, 1 - x + y - z, 1 - x - y + z]
    cross = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]]
    pair = {(1, 2): m[1][0] + m[0][1], (1, 3): m[0][2] + m[2][0], (2, 3): m[2][1] + m[1][2]}

    def entry(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        return diagonal[i] if i == j else cross[j - 1] if i == 0 else pair[(i, j)]

    largest = F.greatest(*diagonal)
    column = []
    for i in range(4):
        value = entry(i, 3)
        for k in (2, 1, 0):
            value = F.when(diagonal[k] == largest, entry(i, k)).otherwise(value)
        column.append(value)
    scale = F.when(column[0] < 0, -0.5).otherwise(0.5) / F.sqrt(largest)
    return [c * scale for c in column]


def invert_rigid(r, t):
    """Inverse of [R|t]: [R'|-R't]."""
    back = transpose(r)
    return back, [-c for c in times(back, t)]


def relative_pose(ri, ti, rj, tj):
    """inverse(Ti) times Tj."""
    back, origin = invert_rigid(ri, ti)
    return product(back, rj), [a + b for a, b in zip(times(back, tj), origin)]


def apply_similarity(s, r, t, p) -> list[Column]:
    """s R p + t for a column vector."""
    return [s * a + b for a, b in zip(times(r, p), t)]


def invert_similarity(s, r, t, p) -> list[Column]:
    """R' (p - t) / s."""
    return [c / s for c in times(transpose(r), [a - b for a, b in zip(p, t)])]


def relative_similarity(sa, ra, ta, sb, rb, tb):
    """The similarity taking frame a's transform to frame b's."""
    s = sb / sa
    r = product(rb, transpose(ra))
    return s, r, [b - s * c for b, c in zip(tb, times(r, ta))]


def back_project(u, v, depth, fx, fy, cx, cy, c2w_r, c2w_t) -> list[Column]:
    """World point of a pixel at a depth through a pinhole camera."""
    ray = [(u - cx) / fx * depth, (v - cy) / fy * depth, depth]
    return [a + b for a, b in zip(times(c2w_r, ray), c2w_t)]


def project(p, w2c_r, w2c_t, fx, fy, cx, cy) -> Vec:
    """Pixel and depth of a world point."""
    x, y, z = [a + b for a, b in zip(times(w2c_r, p), w2c_t)]
    return fx * x / z + cx, fy * y / z + cy, z


def world_ray(u, v, fx, fy, cx, cy, c2w_r) -> list[Column]:
    """Unit viewing direction in the world frame."""
    ray = [(u - cx) / fx, (v - cy) / fy, F.lit(1.0)]
    norm = F.sqrt(ray[0] * ray[0] + ray[1] * ray[1] + 1.0)
    return times(c2w_r, [c / norm for c in ray])


def focal_from_fov(size, fov) -> Column:
    return (size / 2.0) / F.greatest(F.tan(fov / 2.0), F.lit(1e-6))


def fov_from_focal(size, focal) -> Column:
    return 2.0 * F.atan((size / 2.0) / focal)


def rescale_intrinsics(fx, fy, cx, cy, w, h, new_w, new_h):
    return fx * new_w / w, fy * new_h / h, cx * new_w / w, cy * new_h / h


def crop_intrinsics(cx, cy, w, h, new_w, new_h):
    return cx - F.floor((w - new_w) / 2), cy - F.floor((h - new_h) / 2)
