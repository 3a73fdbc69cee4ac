"""Small driver-side records: what is asked, never the data itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from fairfold import fixed


class RefusedError(ValueError):
    """A request that cannot be answered honestly; ``code`` says why."""

    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class TaskSpec:
    target: str
    task_type: str  # binary | multiclass | regression
    features: tuple[str, ...]
    labels: tuple[str, ...] = ()
    positive: str | None = None
    group: str | None = None
    time: str | None = None
    row_id: str = "row_id"

    @property
    def is_classification(self) -> bool:
        return self.task_type != "regression"

    @property
    def metric_positive(self) -> str | None:
        """Positive label for threshold metrics: declared, otherwise the last label."""
        return self.positive or (self.labels[-1] if self.labels else None)


@dataclass(frozen=True)
class Protocol:
    splitter: str
    n_splits: int = fixed.DEFAULT_SPLITS
    holdout: str = "random"
    holdout_size: float = fixed.DEFAULT_HOLDOUT
    seed: int = fixed.DEFAULT_SEED
    notes: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()

    @property
    def forward(self) -> bool:
        return self.splitter == "forward_chaining"

    @property
    def shuffle(self) -> bool:
        return not self.forward


@dataclass(frozen=True)
class Constraint:
    metric: str
    operator: str  # gte | lte
    value: float


@dataclass(frozen=True)
class Objective:
    metric: str
    task_type: str
    constraints: tuple[Constraint, ...] = ()
    tie_breakers: tuple[str, ...] = fixed.TIE_BREAKERS
    min_gain: float = 0.0

    def __post_init__(self) -> None:
        known = fixed.METRICS_BY_TASK[self.task_type]
        for name in (self.metric, *(c.metric for c in self.constraints)):
            if name not in known:
                raise RefusedError("unknown_metric", f"{name} is not measured for {self.task_type}")
        for rule in self.tie_breakers:
            if rule not in fixed.TIE_BREAKERS:
                raise RefusedError("unknown_tie_breaker", rule)
        for c in self.constraints:
            if c.operator not in ("gte", "lte"):
                raise RefusedError("unknown_constraint", c.operator)

    @classmethod
    def default(cls, task_type: str) -> Objective:
        return cls(fixed.PRIMARY_METRIC[task_type], task_type)

    @property
    def higher_is_better(self) -> bool:
        return fixed.METRIC_DIRECTION[self.metric] == "higher"


@dataclass(frozen=True)
class FeatureKinds:
    numeric: tuple[str, ...] = field(default=())
    datetime: tuple[str, ...] = field(default=())
    categorical: tuple[str, ...] = field(default=())
