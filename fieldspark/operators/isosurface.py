"""Isosurfaces: a body-centred cubic lattice, marching tetrahedra over it, and mesh clean-up.

Nodes, field values, sign changes and triangles are DataFrame stages: each node goes to the eight lattice cells it is a corner of, one
shuffle brings a cell's corners together, and only cells with a sign change go on. The resulting mesh is an object on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..geometry import Bbox
from ..plans.tables import written

#: Basis of the lattice, for a resolution of 1.
BASIS = np.array([[1 / np.sqrt(3), np.sqrt(2 / 3), 0.0], [-1 / np.sqrt(3), 0.0, np.sqrt(2 / 3)], [1 / np.sqrt(3), -np.sqrt(2 / 3), 0.0]])
CORNERS = np.array(list(product((0, 1), repeat=3)))
#: A cell's six tetrahedra: the paths along its edges from (0, 0, 0) to (1, 1, 1).
TETRAHEDRA = np.array([[0, *(int(sum(1 << (2 - a) for a in p[: k + 1])) for k in range(3))] for p in permutations(range(3))])
SNAP = 1e-10


@dataclass
class Mesh:
    vertices: np.ndarray
    faces: np.ndarray
    entire: bool = False
    owners: np.ndarray | None = field(default=None, repr=False)

    def export_obj(self, spark: SparkSession, path: str) -> None:
        """Wavefront OBJ as one text file in a folder; faces count from 1."""
        lines = [f"v {x!r} {y!r} {z!r}" for x, y, z in self.vertices.tolist()] + [f"f {a + 1} {b + 1} {c + 1}" for a, b, c in self.faces.tolist()]
        if not len(self.faces):
            lines = ["# entire" if self.entire else "# empty"]
        spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i long, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)

    def edges(self) -> dict[tuple[int, int], int]:
        return {(int(f[k]), int(f[(k + 1) % 3])): i for i, f in enumerate(self.faces) for k in range(3)}


@dataclass(frozen=True)
class Lattice:
    bbox: Bbox
    resolution: float
    aniso: np.ndarray | None = None

    @property
    def basis(self) -> np.ndarray:
        b = self.resolution * BASIS
        return b if self.aniso is None else b @ np.linalg.inv(np.asarray(self.aniso, float)).T

    @property
    def origin(self) -> np.ndarray:
        """Rounded, so that the lattice doesn't depend on the box."""
        return np.round(self.bbox.center() @ np.linalg.inv(self.basis))

    def position(self, ijk: np.ndarray) -> np.ndarray:
        return (self.origin + ijk) @ self.basis

    def extended(self, times: int) -> Bbox:
        n = np.array([d for d in product((-1, 0, 1), repeat=3) if any(d) and (min(d) >= 0 or max(d) <= 0)]) @ self.basis
        return Bbox(tuple(self.bbox.low + times * 1.01 * n.min(0)), tuple(self.bbox.high + times * 1.01 * n.max(0)))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """i, j, k, x, y, z of the nodes in the twice extended box."""
        box = self.extended(2)
        u = box.corners() @ np.linalg.inv(self.basis) - self.origin
        lo, hi = np.floor(u.min(0)).astype(int), np.ceil(u.max(0)).astype(int)
        df = spark.range(int(lo[2]), int(hi[2]) + 1).select(F.col("id").cast("int").alias("k"))
        df = df.withColumn("j", F.explode(F.sequence(F.lit(int(lo[1])), F.lit(int(hi[1]))))).withColumn("i", F.explode(F.sequence(F.lit(int(lo[0])), F.lit(int(hi[0])))))
        o, b = self.origin, self.basis
        x = [sum(((F.col(c) + float(o[r])) * float(b[r, a]) for r, c in enumerate("ijk")), F.lit(0.0)) for a in range(3)]
        return df.select("i", "j", "k", *(c.alias(n) for c, n in zip(x, "xyz", strict=True))).where(box.inside(["x", "y", "z"]))


Field = Callable[[DataFrame], DataFrame]  # points with x, y, z -> the same with a value column


def raw_triangles(nodes: DataFrame, isovalue: float = 0.0) -> DataFrame:
    """i, j, k, corner values -> for each triangle its three lattice edges and where they are cut.

    A node belongs to the negative side if its value less the isovalue is below 0. Columns a0..a2, b0..b2 (packed node codes, a < b) and t0..t2.
    """
    v = nodes.select("i", "j", "k", (F.col("value") - isovalue).alias("v"))
    corner = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), (F.col("i") - int(d[0])).alias("i"), (F.col("j") - int(d[1])).alias("j"), (F.col("k") - int(d[2])).alias("k")) for c, d in enumerate(CORNERS))))
    at = v.select("v", corner.alias("s")).groupBy("s.i", "s.j", "s.k").agg(*(F.max(F.when(F.col("s.c") == c, F.col("v"))).alias(f"v{c}") for c in range(8)), F.min(F.col("v") < 0).alias("all"), F.max(F.col("v") < 0).alias("some"), F.count(F.lit(1)).alias("n"))
    at = at.where("some and not all").select("i", "j", "k", *(f"v{c}" for c in range(8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ijk = np.stack([b.column(c).to_numpy() for c in "ijk"], 1)
            val = np.stack([b.column(f"v{c}").to_numpy(zero_copy_only=False) for c in range(8)], 1).astype(float)
            out = []
            for t in TETRAHEDRA:
                w = val[:, t]
                full = ~np.isnan(w).any(1)
                neg = w < 0
                for mask in range(1, 15):
                    inside = [m for m in range(4) if mask >> m & 1]
                    rows = np.flatnonzero(full & (neg == [m in inside for m in range(4)]).all(1))
                    if not len(rows):
                        continue
                    outside = [m for m in range(4) if m not in inside]
                    if len(inside) == 2:
                        (p, q), (r, s) = inside, outside
                        quad = [(p, r), (p, s), (q, s), (q, r)]
                        tris = [(quad[0], quad[1], quad[2]), (quad[0], quad[2], quad[3])]
                    else:
                        lone = inside[0] if len(inside) == 1 else outside[0]
                        tris = [tuple((lone, m) for m in range(4) if m != lone)]
                    for tri in tris:
                        # winding: seen from the positive side, counter-clockwise
                        mid = np.array([(CORNERS[t[x]] + CORNERS[t[y]]) / 2 for x, y in tri])
                        normal = np.cross(mid[1] - mid[0], mid[2] - mid[0])
                        toward = CORNERS[t[outside]].mean(0) - CORNERS[t[inside]].mean(0)
                        if normal @ toward * np.linalg.det(BASIS) < 0:
                            tri = (tri[0], tri[2], tri[1])
                        cols = []
                        for x, y in tri:
                            a, c = sorted((t[x], t[y]))
                            va, vc = val[rows, a], val[rows, c]
                            cols.append((code(ijk[rows] + CORNERS[a]), code(ijk[rows] + CORNERS[c]), va / (va - vc)))
                        out.append([*(c[0] for c in cols), *(c[1] for c in cols), *(c[2] for c in cols)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(9)], names=[*(f"a{k}" for k in range(3)), *(f"b{k}" for k in range(3)), *(f"t{k}" for k in range(3))])

    return at.mapInArrow(run, ", ".join([*(f"a{k} long" for k in range(3)), *(f"b{k} long" for k in range(3)), *(f"t{k} double" for k in range(3))]))


def code(ijk: np.ndarray) -> np.ndarray:
    return ((ijk[:, 0].astype(np.int64) + (1 << 20)) << 42) | ((ijk[:, 1].astype(np.int64) + (1 << 20)) << 21) | (ijk[:, 2].astype(np.int64) + (1 << 20))


def decode(c: np.ndarray) -> np.ndarray:
    m = (1 << 21) - 1
    return np.stack(((c >> 42) & m, (c >> 21) & m, c & m), 1) - (1 << 20)


def march(spark: SparkSession, lattice: Lattice, f: Field, isovalue: float = 0.0, most: int = 5_000_000) -> Mesh:
    """The raw mesh; each vertex knows the lattice node it is nearest to."""
    nodes = f(lattice.nodes(spark))
    tri = written(raw_triangles(nodes, isovalue), spark)
    if tri.count() > most:  # before any of them comes to the driver
        raise ValueError(f"more than {most} triangles")
    t = tri.toArrow()
    if not t.num_rows:
        return Mesh(np.zeros((0, 3)), np.zeros((0, 3), int), _entire(nodes, lattice, isovalue), np.zeros(0, np.int64))
    a, b, s = (np.stack([t.column(f"{c}{k}").to_numpy() for k in range(3)], 1) for c in "abt")
    key, first, inv = np.unique(np.stack((a.ravel(), b.ravel()), 1), axis=0, return_index=True, return_inverse=True)
    cut = s.ravel()[first]
    own = np.where(cut < 0.5, key[:, 0], key[:, 1])
    cut = np.clip(cut, 1e-4, 1 - 1e-4)[:, None]
    x = (1 - cut) * lattice.position(decode(key[:, 0])) + cut * lattice.position(decode(key[:, 1]))
    box, near = lattice.bbox, SNAP * lattice.resolution
    for edge in (np.array(box.low), np.array(box.high)):
        x = np.where(np.abs(x - edge) < near, edge, x)
    faces = inv.reshape(-1, 3)
    return Mesh(x, faces, False, own)


def _entire(nodes: DataFrame, lattice: Lattice, isovalue: float) -> bool:
    """Without a surface: whether the middle lies on the negative side."""
    c = lattice.bbox.center()
    d = sum(((F.col(a) - float(v)) * (F.col(a) - float(v)) for a, v in zip("xyz", c, strict=True)), F.lit(0.0))
    r = nodes.agg(F.min_by("value", d)).first()
    return r[0] is not None and r[0] < isovalue


def singular_vertices(faces: np.ndarray, n: int) -> np.ndarray:
    """Vertices whose link is neither one cycle nor one path."""
    link: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, c in faces.tolist():
        link[a].append((b, c)), link[b].append((c, a)), link[c].append((a, b))
    bad = []
    for v, e in enumerate(link):
        if not e:
            continue
        nxt: dict[int, int] = {}
        ok = True
        for p, q in e:
            ok &= p not in nxt
            nxt[p] = q
        if ok:
            starts = set(nxt) - set(nxt.values())
            at = next(iter(starts)) if starts else e[0][0]
            seen = 0
            while at in nxt and seen < len(e):
                at, seen = nxt[at], seen + 1
            ok = seen == len(e) and len(starts) <= 1
        if not ok:
            bad.append(v)
    return np.array(bad, int)


def tidy(mesh: Mesh) -> Mesh:
    """Without degenerate faces, faces that occur twice back to back, and unused vertices."""
    f = mesh.faces
    f = f[(f[:, 0] != f[:, 1]) & (f[:, 1] != f[:, 2]) & (f[:, 0] != f[:, 2])]
    if len(f):
        key = np.sort(f, axis=1)
        _, inv, size = np.unique(key, axis=0, return_inverse=True, return_counts=True)
        f = f[size[inv.ravel()] == 1]
    use = np.unique(f)
    to = np.full(len(mesh.vertices), -1)
    to[use] = np.arange(len(use))
    return Mesh(mesh.vertices[use], to[f] if len(f) else f, mesh.entire, None if mesh.owners is None else mesh.owners[use])


def cluster(mesh: Mesh, lattice: Lattice) -> Mesh:
    """Merges the connected vertices of one lattice node to a point that fits their faces' planes; merges that spoil the mesh are undone."""
    n = len(mesh.vertices)
    inner = lattice.extended(1).contains(mesh.vertices)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    e = np.unique(np.sort(np.concatenate((mesh.faces[:, :2], mesh.faces[:, 1:], mesh.faces[:, ::2])), axis=1), axis=0)
    for a, b in e[(mesh.owners[e[:, 0]] == mesh.owners[e[:, 1]]) & inner[e].all(1)].tolist():
        root[find(a)] = find(b)
    group = np.array([find(i) for i in range(n)])
    for _ in range(20):
        x = _quadric(mesh, group, lattice)
        out = tidy(Mesh(x, group[mesh.faces], mesh.entire, mesh.owners))
        bad = singular_vertices(group[tidy_faces(group[mesh.faces])], n) if len(out.faces) else np.zeros(0, int)
        if not len(bad):
            return out
        group = np.where(np.isin(group, bad), np.arange(n), group)
    return out


def tidy_faces(f: np.ndarray) -> np.ndarray:
    f = f[(f[:, 0] != f[:, 1]) & (f[:, 1] != f[:, 2]) & (f[:, 0] != f[:, 2])]
    _, inv, size = np.unique(np.sort(f, axis=1), axis=0, return_inverse=True, return_counts=True)
    return f[size[inv.ravel()] == 1]


def _quadric(mesh: Mesh, group: np.ndarray, lattice: Lattice) -> np.ndarray:
    """For each group the point with the least area-weighted distance to the planes of its faces, near the centroid and in the node's cell."""
    x, f = mesh.vertices, mesh.faces
    size = np.bincount(group, minlength=len(x)).astype(float)
    mid = np.stack([np.bincount(group, x[:, k], len(x)) for k in range(3)], 1) / np.maximum(size, 1)[:, None]
    normal = np.cross(x[f[:, 1]] - x[f[:, 0]], x[f[:, 2]] - x[f[:, 0]])
    area = np.linalg.norm(normal, axis=1)
    unit = normal / np.maximum(area, 1e-300)[:, None]
    a, b = np.zeros((len(x), 3, 3)), np.zeros((len(x), 3))
    for k in range(3):
        g = group[f[:, k]]
        off = (unit * (x[f[:, 0]] - mid[g])).sum(1)
        np.add.at(a, g, area[:, None, None] * unit[:, :, None] * unit[:, None, :])
        np.add.at(b, g, (area * off)[:, None] * unit)
    many = np.flatnonzero(size > 1)
    w, v = np.linalg.eigh(a[many])
    inv = np.where(w > 1e-3 * w[:, -1:], 1 / np.maximum(w, 1e-300), 0)
    step = np.einsum("nij,nj,nkj,nk->ni", v, inv, v, b[many])
    out = x.copy()
    new = mid[many] + step
    back = np.linalg.inv(lattice.basis)
    cell = decode(mesh.owners[many]).astype(float)
    u = np.clip(new @ back - lattice.origin, cell - 0.495, cell + 0.495)
    out[many] = (u + lattice.origin) @ lattice.basis
    return out


def refine(mesh: Mesh, f: Callable[[np.ndarray], np.ndarray], resolution: float, isovalue: float = 0.0) -> Mesh:
    """One Newton step for each vertex along a gradient from four samples; a step that turns a face by a right angle is dropped."""
    if not len(mesh.vertices):
        return mesh
    d = 1e-3 * resolution
    tet = np.array([[1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1]]) / np.sqrt(3)
    x = mesh.vertices
    v = f((x[:, None] + d * tet).reshape(-1, 3)).reshape(-1, 4) - isovalue
    g = (v @ tet) * 0.75 / d
    norm = (g * g).sum(1)
    step = -(v.mean(1) / np.maximum(norm, 1e-300))[:, None] * g
    size = np.linalg.norm(step, axis=1)
    step *= np.minimum(1, 0.5 * resolution / np.maximum(size, 1e-300))[:, None]
    step[norm == 0] = 0
    new = x + step
    for _ in range(10):
        was = np.cross(x[mesh.faces[:, 1]] - x[mesh.faces[:, 0]], x[mesh.faces[:, 2]] - x[mesh.faces[:, 0]])
        now = np.cross(new[mesh.faces[:, 1]] - new[mesh.faces[:, 0]], new[mesh.faces[:, 2]] - new[mesh.faces[:, 0]])
        bad = np.unique(mesh.faces[(was * now).sum(1) <= 0])
        bad = bad[(new[bad] != x[bad]).any(1)]
        if not len(bad):
            break
        new[bad] = x[bad]
    return Mesh(new, mesh.faces, mesh.entire, mesh.owners)


def clip(mesh: Mesh, bbox: Bbox) -> Mesh:
    """The part inside the box: six half spaces in turn; a cut edge gives the same point from both its faces."""
    x, f = mesh.vertices, mesh.faces
    for axis in range(3):
        for sign, edge in ((1.0, bbox.low[axis]), (-1.0, bbox.high[axis])):
            if not len(f):
                break
            d = sign * (x[:, axis] - edge)
            inn = d >= 0
            n = inn[f].sum(1)
            done, cut = [f[n == 3]], {}
            more: list[np.ndarray] = []

            def point(a: int, b: int, x=x, d=d, cut=cut, more=more, axis=axis, edge=edge) -> int:
                a, b = min(a, b), max(a, b)
                if (a, b) not in cut:
                    p = x[a] + (x[b] - x[a]) * (d[a] / (d[a] - d[b]))
                    p[axis] = edge
                    cut[a, b] = len(x) + len(more)
                    more.append(p)
                return cut[a, b]

            new = []
            for t in f[(n == 1) | (n == 2)].tolist():
                k = next(k for k in range(3) if inn[t[k]] != inn[t[(k + 1) % 3]] and inn[t[k]] != inn[t[(k + 2) % 3]])
                a, b, c = t[k], t[(k + 1) % 3], t[(k + 2) % 3]
                ab, ca = point(a, b), point(c, a)
                new += [(a, ab, ca)] if inn[a] else [(ab, b, c), (ab, c, ca)]
            x = np.concatenate((x, np.array(more).reshape(-1, 3)))
            f = np.concatenate((*done, np.array(new, int).reshape(-1, 3)))
    u, inv = np.unique(x, axis=0, return_inverse=True)
    return tidy(Mesh(u, inv.ravel()[f] if len(f) else f, mesh.entire))


def smooth(mesh: Mesh, resolution: float) -> Mesh:
    """Edge flips that lower the total bend around the edge by more than 1e-6; new edges stay below 1.3 resolutions or the old length."""
    x, faces = mesh.vertices, mesh.faces.copy()
    edge = mesh.edges()
    unit = lambda a, b, c: (lambda n: n / max(np.linalg.norm(n), 1e-300))(np.cross(x[b] - x[a], x[c] - x[a]))

    def bend(n1: np.ndarray, n2: np.ndarray) -> float:
        return float(np.arccos(np.clip(n1 @ n2, -1, 1)))

    budget, queue = 50 * len(faces), [k for k in edge if k[0] < k[1]]
    while queue and budget:
        a, b = queue.pop()
        if (a, b) not in edge or (b, a) not in edge:
            continue
        i, j = edge[a, b], edge[b, a]
        c, d = int(sum(faces[i]) - a - b), int(sum(faces[j]) - a - b)
        if (c, d) in edge or (d, c) in edge or c == d:
            continue
        long = float(((x[c] - x[d]) ** 2).sum())
        if long > max(float(((x[a] - x[b]) ** 2).sum()), (1.3 * resolution) ** 2):
            continue
        n1, n2, m1, m2 = unit(a, b, c), unit(b, a, d), unit(c, d, b), unit(d, c, a)
        if m1 @ (n1 + n2) <= 0 or m2 @ (n1 + n2) <= 0:
            continue
        ring = []
        for p, q in ((b, c), (c, a), (a, d), (d, b)):
            k = edge.get((q, p))
            ring.append(None if k is None else unit(*faces[k]))
        before = bend(n1, n2) + sum(bend(n, r) for n, r in zip((n1, n1, n2, n2), ring, strict=True) if r is not None)
        after = bend(m1, m2) + sum(bend(n, r) for n, r in zip((m1, m2, m2, m1), ring, strict=True) if r is not None)
        if before - after > 1e-6:
            budget -= 1
            for p, q in ((a, b), (b, a)):
                del edge[p, q]
            faces[i], faces[j] = (c, d, b), (d, c, a)
            for k in (i, j):
                for s in range(3):
                    edge[int(faces[k][s]), int(faces[k][(s + 1) % 3])] = k
            queue += [(b, c), (c, a), (a, d), (d, b)]
    return Mesh(x, faces, mesh.entire, mesh.owners)


def closest_on_triangles(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest point of each triangle: the plane's foot if it is inside, else the best of the edges' feet."""
    n = np.cross(b - a, c - a)
    nn = np.maximum((n * n).sum(1), 1e-300)
    foot = p - n * (((p - a) * n).sum(1) / nn)[:, None]
    inside = np.ones(len(a), bool)
    best, dist = foot, np.full(len(a), np.inf)
    for u, v in ((a, b), (b, c), (c, a)):
        inside &= (np.cross(v - u, foot - u) * n).sum(1) >= 0
        e = v - u
        t = np.clip(((p - u) * e).sum(1) / np.maximum((e * e).sum(1), 1e-300), 0, 1)[:, None]
        q = u + t * e
        d = ((q - p) ** 2).sum(1)
        best, dist = np.where((d < dist)[:, None], q, best), np.minimum(d, dist)
    return np.where(inside[:, None], foot, best)


def snap(mesh: Mesh, points: np.ndarray, resolution: float, tolerance: np.ndarray | float = 0.0) -> tuple[Mesh, np.ndarray]:
    """Makes points vertices, nearest first, where a face is within a resolution: moves the nearest corner or splits the face.

    An edit that folds a face or makes neighbouring normals point apart is undone. Returns the mesh and which points are honoured.
    """
    x, faces = mesh.vertices.copy(), [tuple(f) for f in mesh.faces.tolist()]
    tol = np.broadcast_to(np.asarray(tolerance, float), len(points))
    if ((tol < 0) | (tol > resolution)).any():
        raise ValueError("tolerances must be between 0 and the resolution")
    ok, taken = np.zeros(len(points), bool), set()
    if not faces or not len(points):
        return mesh, ok

    def near(p):
        f = np.array(faces)
        q = closest_on_triangles(p, x[f[:, 0]], x[f[:, 1]], x[f[:, 2]])
        d = ((q - p) ** 2).sum(1)
        return int(d.argmin()), float(np.sqrt(d.min()))

    dist = [near(p)[1] for p in points]
    for k in sorted(range(len(points)), key=lambda k: (dist[k], *points[k])):
        p = points[k]
        i, d = near(p)
        if d > resolution:
            continue
        if d <= tol[k]:
            ok[k] = True
            continue
        corner = min(faces[i], key=lambda v: float(((x[v] - p) ** 2).sum()))
        star = [f for f in faces if corner in f]
        was = [np.cross(x[f[1]] - x[f[0]], x[f[2]] - x[f[0]]) for f in star]
        if corner not in taken:
            old = x[corner].copy()
            x[corner] = p
            now = [np.cross(x[f[1]] - x[f[0]], x[f[2]] - x[f[0]]) for f in star]
            if all(u @ v > 0.1 * np.linalg.norm(u) * np.linalg.norm(v) and np.linalg.norm(v) > 1e-9 * resolution**2 for u, v in zip(was, now, strict=True)):
                taken.add(corner)
                ok[k] = True
                continue
            x[corner] = old
        a, b, c = faces[i]
        n = np.cross(x[b] - x[a], x[c] - x[a])
        parts = [(a, b, len(x)), (b, c, len(x)), (c, a, len(x))]
        y = np.concatenate((x, p[None]))
        if all((lambda m: m @ n > 0.1 * np.linalg.norm(m) * np.linalg.norm(n) and np.linalg.norm(m) > 1e-9 * resolution**2)(np.cross(y[t[1]] - y[t[0]], y[t[2]] - y[t[0]])) for t in parts):
            x = y
            taken.add(len(x) - 1)
            faces[i : i + 1] = parts
            ok[k] = True
    return Mesh(x, np.array(faces), mesh.entire), ok


def thin(mesh: Mesh, snapped: np.ndarray, resolution: float) -> Mesh:
    """Collapses edges between vertices at snapped points where the link condition holds, nothing folds and edges stay short."""
    x, faces = mesh.vertices, {i: tuple(f) for i, f in enumerate(mesh.faces.tolist())}
    marked = {i for i, v in enumerate(map(tuple, x)) if v in set(map(tuple, snapped))}
    star: dict[int, set[int]] = {}
    for i, f in faces.items():
        for v in f:
            star.setdefault(v, set()).add(i)
    around = lambda v: {w for i in star.get(v, ()) for w in faces[i]} - {v}
    for v in sorted(marked):
        ring = around(v)
        if len(star.get(v, ())) != len(ring) or len(ring) < 3:
            continue
        best = None
        for w in sorted(ring & marked):
            if len(ring & around(w)) != 2:
                continue
            bad, cost = False, 0.0
            for i in star[v]:
                f = faces[i]
                if w in f:
                    continue
                g = tuple(w if u == v else u for u in f)
                n, m = (np.cross(x[h[1]] - x[h[0]], x[h[2]] - x[h[0]]) for h in (f, g))
                bad |= n @ m <= 0 or max(((x[g[s]] - x[g[(s + 1) % 3]]) ** 2).sum() for s in range(3)) > (1.3 * resolution) ** 2
                cost = max(cost, abs(float((x[v] - x[w]) @ m) / max(np.linalg.norm(m), 1e-300)))
            if not bad and cost < 1e-9 * resolution and (best is None or cost < best[0]):
                best = (cost, w)
        if best:
            for i in list(star.pop(v)):
                f = faces.pop(i)
                for u in f:
                    star.get(u, set()).discard(i)
                if best[1] not in f:
                    faces[i] = tuple(best[1] if u == v else u for u in f)
                    for u in faces[i]:
                        star.setdefault(u, set()).add(i)
    return tidy(Mesh(x, np.array(list(faces.values()) or np.zeros((0, 3)), int), mesh.entire))


def intersecting_faces(mesh: Mesh) -> np.ndarray:
    """Pairs of faces without a common vertex that cross: candidates by boxes along the longest axis, then edges against triangles."""
    x, f = mesh.vertices, mesh.faces
    lo, hi = x[f].min(1), x[f].max(1)
    order = np.argsort(lo[:, 0], kind="stable")
    out = []

    def crosses(tri: np.ndarray, p: np.ndarray, q: np.ndarray) -> bool:
        n = np.cross(tri[1] - tri[0], tri[2] - tri[0])
        s, t = (p - tri[0]) @ n, (q - tri[0]) @ n
        if s * t >= 0:
            return False
        z = p + (q - p) * (s / (s - t))
        return all(np.cross(tri[(k + 1) % 3] - tri[k], z - tri[k]) @ n > 0 for k in range(3))

    for a, i in enumerate(order):
        for j in order[a + 1 :]:
            if lo[j, 0] > hi[i, 0]:
                break
            if (lo[j] <= hi[i]).all() and (lo[i] <= hi[j]).all() and not set(f[i]) & set(f[j]):
                p, q = x[f[i]], x[f[j]]
                if any(crosses(p, q[k], q[(k + 1) % 3]) or crosses(q, p[k], p[(k + 1) % 3]) for k in range(3)):
                    out.append(sorted((int(i), int(j))))
    return np.array(sorted(out), int).reshape(-1, 2)


def components_of_seeds(mesh: Mesh, seeds: np.ndarray) -> Mesh:
    """The connected parts of a surface that are nearest to the seed points."""
    if not len(seeds):
        raise ValueError("seed points are needed")
    if not len(mesh.faces):
        return mesh
    part = np.arange(len(mesh.vertices))
    while True:
        low = part.copy()
        for k in range(3):
            np.minimum.at(low, mesh.faces[:, k], part[mesh.faces].min(1))
        low = low[low]
        if (low == part).all():
            break
        part = low
    use = {int(part[((mesh.vertices - s) ** 2).sum(1).argmin()]) for s in seeds}
    return tidy(Mesh(mesh.vertices, mesh.faces[np.isin(part[mesh.faces[:, 0]], list(use))], mesh.entire, mesh.owners))


def generate(spark: SparkSession, bbox: Bbox, resolution: float, f: Field, isovalue: float = 0.0, aniso: np.ndarray | None = None, local: Callable | None = None, seeds: np.ndarray | None = None, snap_points: np.ndarray | None = None, tolerance: np.ndarray | float = 0.0) -> Mesh:
    """The isosurface of a field inside the box. local: the same field over arrays, for the refinement of vertices."""
    if aniso is not None and np.linalg.det(aniso) <= 0:
        raise ValueError("an anisotropy must have a positive determinant")
    lattice = Lattice(bbox, resolution, aniso)
    mesh = march(spark, lattice, f, isovalue)
    if not len(mesh.faces):
        return mesh
    if seeds is not None:
        mesh = components_of_seeds(mesh, seeds)
    mesh = cluster(mesh, lattice)
    if local is not None:
        mesh = refine(mesh, local, resolution, isovalue)
    mesh = smooth(mesh, resolution) if snap_points is not None else mesh
    if snap_points is not None:
        mesh, ok = snap(mesh, snap_points, resolution, tolerance)
        mesh = smooth(thin(mesh, snap_points[ok], resolution), resolution)
    out = clip(mesh, bbox)
    if not len(out.faces):
        out.entire = _entire(f(lattice.nodes(spark)), lattice, isovalue)
    return out


def field_of(interpolant) -> Field:
    return lambda df: interpolant.evaluate(df, on=["x", "y", "z"])


def field_25d(interpolant) -> Field:
    """z - s(x, y): the surface of a function over the plane."""
    return lambda df: interpolant.evaluate(df, name="_s", on=["x", "y"]).withColumn("value", F.col("z") - F.col("_s")).drop("_s")
