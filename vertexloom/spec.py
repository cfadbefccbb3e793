"""Graph specifications: option strings, and the deduction of missing parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

from .functions import hyperbolic_radius, newton

MODELS = ("gnm_undirected", "gnm_directed", "gnp_undirected", "gnp_directed", "rgg2d", "rgg3d", "rdg2d", "rdg3d", "rhg", "ba", "grid2d", "grid3d", "path", "kronecker", "rmat", "image", "file")
ALIASES = {"prob": "p", "radius": "r", "gamma": "g", "avg_degree": "d", "min_degree": "d", "grid_x": "x", "grid_y": "y", "grid_z": "z", "rmat_a": "a", "rmat_b": "b", "rmat_c": "c"}
TRUE = ("1", "true", "yes")


@dataclass(frozen=True)
class Spec:
    model: str
    n: int = 0
    m: int = 0
    k: int = 0
    seed: int = 1
    p: float = 0.0
    r: float = 0.0
    g: float = 2.6
    d: float = 0.0
    x: int = 0
    y: int = 0
    z: int = 0
    a: float = 0.0
    b: float = 0.0
    c: float = 0.0
    directed: bool = False
    self_loops: bool = False
    periodic: bool = False
    coordinates: bool = False
    permute: bool = False
    filename: str = ""
    input_format: str = ""
    weight_model: str = "ratio"
    weight_multiplier: float = 255.0
    weight_offset: float = 0.0
    min_weight_threshold: float = 1.0
    max_weight_threshold: float = math.inf
    neighborhood: int = 4
    redistribution: str = "balance-vertices"
    distribution: str = "balance-vertices"
    edgeweights_generator: str = "default"
    edgeweights_range_begin: int = 1
    edgeweights_range_end: int = 100
    vertexweights_generator: str = "default"
    vertexweights_range_begin: int = 1
    vertexweights_range_end: int = 100


def parse(options: str) -> Spec:
    """"model;key=value;flag": a key without a value means 1; N and M are powers of two; dashes in keys are underscores."""
    found: dict[str, object] = {}
    kinds = {f.name: type(f.default) for f in fields(Spec) if f.name != "model"}
    model = ""
    for part in filter(None, (x.strip() for x in options.split(";"))):
        key, eq, value = part.partition("=")
        if key in ("N", "M"):
            found[key.lower()] = 1 << int(value)
            continue
        name = key.replace("-", "_")
        if name == "type" or (not eq and name in MODELS):
            model = value.replace("-", "_") if name == "type" else name
            continue
        name = ALIASES.get(name, name)
        if name not in kinds:
            raise ValueError(f"unknown option {key!r}")
        value = value if eq else "1"
        found[name] = value.lower() in TRUE if kinds[name] is bool else kinds[name](value)
    if model not in MODELS:
        raise ValueError(f"no model in {options!r}" if not model else f"unknown model {model!r}")
    return Spec(model, **found)


def normalized(s: Spec) -> Spec:
    """s with what follows from the other parameters; raises ValueError where they contradict each other."""
    need = lambda ok, why: None if ok else _fail(f"{s.model}: {why}")
    if s.model.startswith("gnm"):
        cells = s.n * (s.n - 1 + 2 * s.self_loops * (s.model == "gnm_undirected") + s.self_loops * (s.model == "gnm_directed"))
        cells = cells // 2 if s.model == "gnm_undirected" and not s.self_loops else s.n * (s.n + 1) // 2 if s.model == "gnm_undirected" else s.n * (s.n - (not s.self_loops))
        need(s.n > 0 and 0 <= s.m <= cells, f"n={s.n} has {cells} possible edges, not {s.m}")
    elif s.model.startswith("gnp"):
        need(s.n > 0 and 0 <= s.p <= 1, "n must be positive and p a probability")
    elif s.model == "rgg2d":
        if not s.r and s.n and s.m:
            f = lambda r: s.n * (s.n - 1) * r * r * (r * r / 2 - 8 * r / 3 + math.pi) - 2 * s.m
            df = lambda r: s.n * (s.n - 1) * (2 * r**3 - 8 * r * r + 2 * math.pi * r)
            s = replace(s, r=newton(f, df, math.sqrt(2 * s.m / (math.pi * s.n * max(1, s.n - 1)))))
        elif not s.n and s.m and s.r:
            share = s.r**2 * (s.r**2 / 2 - 8 * s.r / 3 + math.pi)
            s = replace(s, n=round((1 + math.sqrt(1 + 8 * s.m / share)) / 2))
        need(s.n > 0 and s.r > 0, "two of n, m and r are needed")
    elif s.model == "rgg3d":
        share = lambda r: r**3 * (4 * math.pi / 3 - 1.5 * math.pi * r + 1.6 * r * r - r**3 / 6)
        if not s.r and s.n and s.m:
            slope = lambda r: (share(r + 1e-7) - share(r - 1e-7)) / 2e-7
            s = replace(s, r=newton(lambda r: s.n * (s.n - 1) * share(r) - 2 * s.m, lambda r: s.n * (s.n - 1) * slope(r), (2 * s.m / (4 * math.pi / 3 * s.n * max(1, s.n - 1))) ** (1 / 3)))
        elif not s.n and s.m and s.r:
            s = replace(s, n=round((1 + math.sqrt(1 + 8 * s.m / share(s.r))) / 2))
        need(s.n > 0 and s.r > 0, "two of n, m and r are needed")
    elif s.model in ("rdg2d", "rdg3d"):
        if not s.n and s.m:
            s = replace(s, n=s.m // 3 + 2 if s.model == "rdg2d" else round(s.m / (15.53 / 2)) + 2)
        need(s.n > 0, "n or m is needed")
    elif s.model == "rhg":
        if not s.d and s.n and s.m:
            s = replace(s, d=2 * s.m / s.n)
        elif not s.n and s.d and s.m:
            s = replace(s, n=round(2 * s.m / s.d))
        need(s.n > 0 and s.d > 0 and s.g > 2, "n, an average degree and gamma above 2 are needed")
        s = replace(s, r=s.r or hyperbolic_radius(s.n, s.d, s.g))
    elif s.model == "ba":
        if not s.d and s.n and s.m:
            s = replace(s, d=float(s.m // s.n))
        elif not s.n and s.d and s.m:
            s = replace(s, n=int(s.m // s.d))
        need(s.n > 0 and s.d >= 1, "n and a degree are needed")
    elif s.model == "grid2d":
        if not (s.x and s.y) and s.n:
            side = math.isqrt(s.n)
            s = replace(s, x=side, y=side)
        if s.m and not s.p:
            s = replace(s, p=2 * s.m / _lattice_edges((s.x, s.y), s.periodic))
        s = replace(s, n=s.x * s.y, p=s.p or 1.0)
        need(s.n > 0 and s.p <= 1, "too many edges for the grid")
    elif s.model == "grid3d":
        if not (s.x and s.y and s.z) and s.n:
            side = round(s.n ** (1 / 3))
            side -= side**3 > s.n
            s = replace(s, x=side, y=side, z=side)
        if s.m and not s.p:
            s = replace(s, p=2 * s.m / _lattice_edges((s.x, s.y, s.z), s.periodic))
        s = replace(s, n=s.x * s.y * s.z, p=s.p or 1.0)
        need(s.n > 0 and s.p <= 1, "too many edges for the grid")
    elif s.model in ("rmat", "kronecker"):
        need(1 <= s.n <= 1 << 31, "n must be from 1 to 2^31")
        s = replace(s, n=1 << (s.n.bit_length() - 1))
        if s.model == "kronecker":
            s = replace(s, a=0.25, b=0.25, c=0.25)
        need(min(s.a, s.b, s.c) >= 0 and s.a + s.b + s.c <= 1, "a, b, c must be probabilities")
    elif s.model == "path":
        need(s.n > 0, "n is needed")
    return s


def _fail(why: str) -> None:
    raise ValueError(why)


def _lattice_edges(sides: tuple[int, ...], periodic: bool) -> int:
    """Directed edges of the whole lattice. A wrapped side of 1 has no edge along it, one of 2 a single one."""
    n = math.prod(sides)
    return sum(2 * (n // k) * ((k if k > 2 else k - 1) if periodic else k - 1) for k in sides)
