"""Models and policies, loaded strictly: an unknown key or a contradiction is an error."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from ..operators.ordering import dependency_order

#: What each policy may be; the first is the default.
POLICIES = {
    "id_drift": ("error", "warn", "ignore"),
    "missing_row": ("error", "warn"),
    "changed_row": ("warn", "error"),
    "zero_default": ("error", "warn", "ignore"),
    "null_default": ("error", "warn", "ignore"),
    "duplicate_key": ("error", "warn"),
    "key_index": ("warn", "error", "ignore"),
    "renames": ("refuse", "update"),
    "deletes": ("allow", "refuse", "cascade"),
    "array_nulls": ("refuse", "keep"),
}
MODES = ("sync", "upsert", "insert")
SEVERITY = {"ignore": 0, "warn": 1, "error": 2}


class ConfigError(ValueError):
    """A configuration that says something impossible."""


@dataclass(frozen=True)
class Policy:
    values: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k, v in self.values.items():
            if k not in POLICIES:
                raise ConfigError(f"unknown policy {k}")
            if v not in POLICIES[k]:
                raise ConfigError(f"policy {k} cannot be {v}; it is one of {', '.join(POLICIES[k])}")

    def __getitem__(self, name: str) -> str:
        return self.values.get(name, POLICIES[name][0])

    def over(self, other: Policy) -> Policy:
        return Policy(other.values | self.values)


@dataclass(frozen=True)
class Model:
    name: str
    table: str
    key: tuple[str, ...]
    id: str | None = "id"
    ref: str | None = None
    key_any_of: tuple[tuple[str, ...], ...] = ()
    refs: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    ignore: tuple[str, ...] = ()
    derived: tuple[str, ...] = ()
    mode: str = "sync"
    insert_only: tuple[str, ...] = ()
    ids: str = "files"
    soft_delete: str | None = None
    where: str | None = None
    policy: Policy = field(default_factory=Policy)

    def __post_init__(self) -> None:
        if not self.key and not self.key_any_of:
            raise ConfigError(f"{self.name}: a model needs a key")
        if self.mode not in MODES:
            raise ConfigError(f"{self.name}: mode is one of {', '.join(MODES)}")
        if clash := set(self.insert_only) & set(self.key):
            raise ConfigError(f"{self.name}: key columns cannot be insert_only: {', '.join(sorted(clash))}")
        if self.mode == "insert" and self.insert_only:
            raise ConfigError(f"{self.name}: mode insert owns no column after the insert, so insert_only says nothing")
        if self.mode == "insert" and self.policy["renames"] == "update":
            raise ConfigError(f"{self.name}: mode insert cannot update names")
        if self.soft_delete and self.soft_delete in (*self.key, *self.insert_only, *self.ignore):
            raise ConfigError(f"{self.name}: the soft-delete column cannot play another part")
        if self.where and (";" in self.where or self.where.count("(") != self.where.count(")") or self.where.count("'") % 2):
            raise ConfigError(f"{self.name}: where is not one condition")

    @property
    def skipped(self) -> set[str]:
        return {c for c in (self.id, self.soft_delete) if c} | set(self.ignore) | set(self.derived)

    def owned(self, columns: list[str]) -> list[str]:
        """The columns that files own in a row that is there."""
        return [c for c in columns if c not in self.skipped and c not in self.key]


@dataclass(frozen=True)
class Config:
    models: dict[str, Model]
    policy: Policy = field(default_factory=Policy)

    def __post_init__(self) -> None:
        for m in self.models.values():
            for column, target in m.refs.items():
                if target not in self.models:
                    raise ConfigError(f"{m.name}.{column} refers to {target}, which is no model")
                kept = m.mode != "sync"
                if kept and self.policy_of(target)["deletes"] == "cascade":
                    raise ConfigError(f"{target}: deletes cascade into {m.name}, whose rows the files do not own")

    def policy_of(self, model: str) -> Policy:
        return self.models[model].policy.over(self.policy)

    def order(self) -> list[str]:
        return dependency_order(list(self.models), {n: m.refs for n, m in self.models.items()})

    def mode_of(self, kind: str, model: str, unsure: bool = False) -> str:
        """How bad a finding is: by the policy of its kind, an error where there is none; unsure ones about indexes warn at most."""
        mode = self.policy_of(model)[kind] if kind in POLICIES else "error"
        return "warn" if unsure and kind == "key_index" and mode == "error" else mode

    def worst(self, found: list[tuple[str, str, bool]]) -> str:
        return max((self.mode_of(*f) for f in found), key=SEVERITY.__getitem__, default="ignore")


def _made(kind, data: dict, where: str):
    known = {f.name for f in fields(kind)}
    if unknown := set(data) - known:
        raise ConfigError(f"{where}: unknown {', '.join(sorted(unknown))}")
    return kind(**data)


def from_dict(data: dict) -> Config:
    if unknown := set(data) - {"models", "policy"}:
        raise ConfigError(f"unknown {', '.join(sorted(unknown))}")
    models = {}
    for name, m in (data.get("models") or {}).items():
        m = {k: tuple(map(tuple, v)) if k == "key_any_of" else tuple(v) if isinstance(v, list) else v for k, v in m.items()}
        m["policy"] = Policy(m.get("policy") or {})
        models[name] = _made(Model, {"name": name, "table": name, "key": ()} | m, name)
    return Config(models, Policy(data.get("policy") or {}))


def load(path: str) -> Config:
    import yaml

    with open(path) as f:
        return from_dict(yaml.safe_load(f) or {})
