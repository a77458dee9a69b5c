"""Statistics of aggregated rows, as SQL expressions of plain arithmetic and exp: executors evaluate them inside generated code.

Arguments are column names or expressions. Division by zero never happens: degenerate cases have the values stated.
"""

from __future__ import annotations

#: Coefficients of the rational Chebyshev approximation of erfc (relative error under 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _d(x: str | float) -> str:
    return f"CAST({x} AS DOUBLE)"


def erfc(x: str) -> str:
    """erfc of a non-negative x, at most 1."""
    t = f"(1e0 / (1e0 + 0.5e0 * ({x})))"
    poly = f"({ERFC[-1]!r}e0)"
    for c in reversed(ERFC[:-1]):
        poly = f"({c!r}e0 + {t} * {poly})"
    return f"least(1e0, {t} * exp(-({x}) * ({x}) + {poly}))"


def rate(s: str, n: str) -> str:
    """Percent; 0 without a denominator."""
    return f"CASE WHEN {n} > 0 THEN 100e0 * {_d(s)} / {_d(n)} ELSE 0e0 END"


def _se2(n1: str, s1: str, n0: str, s0: str) -> str:
    p = f"({_d(f'{s1} + {s0}')} / {_d(f'{n1} + {n0}')})"
    return f"({p} * (1e0 - {p}) * (1e0 / {_d(n1)} + 1e0 / {_d(n0)}))"


def _fit(n1: str, s1: str, n0: str, s0: str) -> str:
    return f"{n1} > 0 AND {n0} > 0 AND {s1} + {s0} > 0 AND {s1} + {s0} < {n1} + {n0}"


def z_test_p(n1: str, s1: str, n0: str, s0: str) -> str:
    """Two-sided p of the pooled two-proportion z-test; 1 for an empty group or a pooled rate of 0 or 1."""
    z = f"(abs({_d(s1)} / {_d(n1)} - {_d(s0)} / {_d(n0)}) / sqrt({_se2(n1, s1, n0, s0)}) / 1.4142135623730951e0)"
    return f"CASE WHEN {_fit(n1, s1, n0, s0)} THEN {erfc(z)} ELSE 1e0 END"


def half_width(n1: str, s1: str, n0: str, s0: str) -> str:
    """Half of the 95 % interval of the lift in points, by the pooled standard error; 0 where the test is degenerate."""
    return f"CASE WHEN {_fit(n1, s1, n0, s0)} THEN 196e0 * sqrt({_se2(n1, s1, n0, s0)}) ELSE 0e0 END"


def lift(n1: str, s1: str, n0: str, s0: str) -> str:
    """Difference of the rates in points."""
    return f"({rate(s1, n1)} - {rate(s0, n0)})"


def relative_lift(n1: str, s1: str, n0: str, s0: str) -> str:
    return f"CASE WHEN {n0} > 0 AND {s0} > 0 THEN 100e0 * {lift(n1, s1, n0, s0)} / ({rate(s0, n0)}) ELSE 0e0 END"


def srm_chi2(n1: str, n0: str, split: str) -> str:
    """Chi-squared (1 df) of the arms' counts against the designed split; 0 without rows."""
    e = f"({_d(f'{n1} + {n0}')} * {split})"
    return f"CASE WHEN {n1} + {n0} > 0 THEN ({_d(n1)} - {e}) * ({_d(n1)} - {e}) * (1e0 / {e} + 1e0 / ({_d(f'{n1} + {n0}')} - {e})) ELSE 0e0 END"


def chi2_p(chi2: str) -> str:
    return erfc(f"sqrt({chi2} / 2e0)")


def significance(p: str) -> str:
    return f"CASE WHEN {p} < 0.001e0 THEN '99.9%' WHEN {p} < 0.01e0 THEN '99%' WHEN {p} < 0.05e0 THEN '95%' ELSE 'No' END"


def stars(p: str) -> str:
    return f"CASE WHEN {p} < 0.001e0 THEN '***' WHEN {p} < 0.01e0 THEN '**' WHEN {p} < 0.05e0 THEN '*' ELSE '' END"


def bucket(value: str, edges: list, labels: list[str], null: str = "UNKNOWN") -> str:
    """The label of the first edge that the value does not exceed; the last label beyond all, `null` for null."""
    return "CASE " + f"WHEN {value} IS NULL THEN '{null}' " + " ".join(f"WHEN {value} <= {e} THEN '{x}'" for e, x in zip(edges, labels, strict=False)) + f" ELSE '{labels[-1]}' END"


def bucket_order(value: str, edges: list) -> str:
    return "CASE " + f"WHEN {value} IS NULL THEN 0 " + " ".join(f"WHEN {value} <= {e} THEN {i + 1}" for i, e in enumerate(edges)) + f" ELSE {len(edges) + 1} END"


