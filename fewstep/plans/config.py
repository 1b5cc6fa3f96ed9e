"""Parameters of building, scoring and evaluating, with presets."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class RunConfig:
    """Defaults of the reference's engine; None in a field switches its rule off."""

    mode: str = "few_switches"
    retrieval: str = "hybrid"
    hybrid_w: float = 0.6
    cand_k: int = 1000
    top_k: int = 20
    a: float = 0.60
    b: float = 0.30
    c: float = 0.10
    a_m: float = 0.55
    a_f: float = 0.15
    b_m: float = 0.15
    b_f: float = 0.05
    gates: bool = True
    min_ingr_recall: float = 0.55
    min_ingr_precision: float = 0.55
    min_ops_recall: float = 0.45
    min_ops_precision: float = 0.30
    min_instr_sim: float = 0.50
    min_switch_cost: float = 0.02
    max_switch_cost: float = 0.25
    explain_top_n: int = 30
    gap_threshold: float = 0.50
    substitution_credit_exp: float = 2.0
    tfidf_heads: bool = True
    tfidf_ops: bool = True
    empty_value: float = 0.0


@dataclass(frozen=True)
class BuildConfig:
    limit: int | None = None
    strict: bool = True
    skip_bad_records: bool = False
    head_neighbors_k: int = 20
    tau_sub: float = 0.75
    use_ann: bool = True


#: Values that a preset sets where the caller set none.
PRESETS = {
    "quality": {"cand_k": 500, "top_k": 20, "explain_top_n": 30},
    "fast": {"cand_k": 200, "explain_top_n": 10},
    "debug": {"top_k": 10, "limit": 200},
}
#: The most records for which all pairs are planned without an index.
EXACT_LIMIT = 50_000


def configured(kind, preset: str | None = None, **explicit):
    """A config of this kind: explicit values before the preset's before the defaults."""
    fields = kind.__dataclass_fields__
    chosen = {k: v for k, v in PRESETS.get(preset or "", {}).items() if k in fields}
    return replace(kind(), **chosen, **explicit) if not (chosen.keys() & explicit.keys()) else replace(kind(), **(chosen | explicit))


def check_exact(config: BuildConfig) -> None:
    """Refuses all pairs without an index above EXACT_LIMIT records."""
    if not config.use_ann and not 0 < (config.limit or 0) <= EXACT_LIMIT:
        raise ValueError(f"without an index, limit must be set and at most {EXACT_LIMIT}")


def dump(config) -> dict:
    return asdict(config)


def sweep(**grid):
    """One dict of parameters for each combination of the grid's values, in order."""
    out = [{}]
    for k, values in grid.items():
        out = [o | {k: v} for o in out for v in values]
    return out
