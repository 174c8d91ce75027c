"""Models: a sum of kernels, a polynomial degree and a nugget."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np

from .functions.kernels import KERNELS, Rbf
from .functions.polynomial import size
from .geometry import decompose_inverse_anisotropy


@dataclass(frozen=True)
class Model:
    rbfs: tuple[Rbf, ...]
    degree: int | None = None
    nugget: float = 0.0

    def __post_init__(self):
        rbfs = (self.rbfs,) if isinstance(self.rbfs, Rbf) else tuple(self.rbfs)
        if not rbfs:
            raise ValueError("a model needs a kernel")
        least = max(r.kernel.order for r in rbfs) - 1
        degree = least if self.degree is None else self.degree
        if not least <= degree <= 2:
            raise ValueError(f"degree must be between {least} and 2")
        if self.nugget < 0:
            raise ValueError("the nugget must not be negative")
        object.__setattr__(self, "rbfs", rbfs)
        object.__setattr__(self, "degree", degree)

    def basis_size(self, dim: int) -> int:
        return size(dim, self.degree)

    # parameter vector: the nugget, then each kernel's two -----------------------------------
    @property
    def parameters(self) -> list[float]:
        return [self.nugget, *(p for r in self.rbfs for p in r.params)]

    @property
    def parameter_names(self) -> list[str]:
        return ["nugget", *(p for r in self.rbfs for p in r.kernel.parameters)]

    @property
    def parameter_bounds(self) -> list[tuple[float, float]]:
        return [(0.0, float("inf"))] * len(self.parameters)

    def with_parameters(self, values: list[float]) -> Model:
        if len(values) != len(self.parameters):
            raise ValueError(f"{len(self.parameters)} parameters expected")
        return replace(self, nugget=float(values[0]), rbfs=tuple(replace(r, params=(float(values[1 + 2 * i]), float(values[2 + 2 * i]))) for i, r in enumerate(self.rbfs)))

    def with_anisotropy(self, a: np.ndarray | None) -> Model:
        m = None if a is None else tuple(map(tuple, np.asarray(a, float)))
        return replace(self, rbfs=tuple(replace(r, aniso=m) for r in self.rbfs))

    def evaluate(self, diff: np.ndarray) -> np.ndarray:
        return sum(r.evaluate(diff) for r in self.rbfs)

    def description(self, dim: int = 3) -> str:
        """Partial sills, ranges along the principal axes and rotation angles in degrees."""
        if not all(r.kernel.covariance for r in self.rbfs):
            raise ValueError("only covariance models have a description")
        rows = [f"nugget {self.nugget:g}"]
        for r in self.rbfs:
            rot, scale = decompose_inverse_anisotropy(r.matrix(dim))
            order = np.argsort(-scale)
            rot, scale = rot[:, order], scale[order]
            if np.linalg.det(rot) < 0:
                rot[:, -1] *= -1
            text = f"{r.name} psill {r.params[0]:g} range " + " ".join(f"{r.params[1] * s:g}" for s in scale)
            if dim == 2:
                text += f" angle {np.degrees(np.arctan2(rot[1, 0], rot[0, 0])) % 180:g}"
            if dim == 3:
                text += f" angles {np.degrees(np.arctan2(rot[1, 0], rot[0, 0])):g} {np.degrees(-np.arcsin(np.clip(rot[2, 0], -1, 1))):g} {np.degrees(np.arctan2(rot[2, 1], rot[2, 2])):g}"
            rows.append(text)
        return "\n".join(rows)

    def to_json(self) -> str:
        return json.dumps({"degree": self.degree, "nugget": self.nugget, "rbfs": [{"name": r.name, "params": r.params, "aniso": r.aniso} for r in self.rbfs]})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        return cls(tuple(Rbf(r["name"], tuple(r["params"]), None if r["aniso"] is None else tuple(map(tuple, r["aniso"]))) for r in d["rbfs"]), d["degree"], d["nugget"])

    @classmethod
    def from_tokens(cls, rbfs: list[list[str]], degree: int | None = None, nugget: float = 0.0, dim: int = 3) -> Model:
        """Each kernel as NAME PARAM... [aniso followed by dim * dim numbers, row by row]."""
        made = []
        for name, *rest in rbfs:
            if name not in KERNELS:
                raise ValueError(f"no kernel {name!r}")
            cut = rest.index("aniso") if "aniso" in rest else len(rest)
            m = list(map(float, rest[cut + 1 :]))
            if cut < len(rest) and len(m) != dim * dim:
                raise ValueError("an anisotropy takes the square of the dimension numbers")
            made.append(Rbf(name, tuple(map(float, rest[:cut])), tuple(tuple(m[i * dim : (i + 1) * dim]) for i in range(dim)) if m else None))
        return cls(tuple(made), degree, nugget)
