"""Vocabularies from YAML: conventions, concepts, scopes, source and platform mappings as small DataFrames.

Loaded on the driver (tens of rows) and broadcast by their users; files may not leave the vocabulary's folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CONTEXT = ("scope", "phase", "role", "phase_system")
REQUIRED = {"concept_id", "name", "description", "value_type"}


class VocabularyError(ValueError):
    """A vocabulary file that can't be used; the message names the file and field."""


def _yaml(path: Path) -> dict:
    import yaml

    try:
        with path.open(encoding="utf-8") as f:
            found = yaml.safe_load(f)
    except (OSError, yaml.YAMLError) as e:
        raise VocabularyError(f"{path.name}: {e}") from e
    if not isinstance(found, dict):
        raise VocabularyError(f"{path.name}: a mapping is needed")
    return found


def _inside(root: Path, name: str) -> Path:
    path = (root / name).resolve()
    if not path.is_relative_to(root.resolve()):
        raise VocabularyError(f"{name}: outside the vocabulary")
    return path


def _need(entry: dict, names: set[str], where: str) -> None:
    if missing := sorted(names - entry.keys()):
        raise VocabularyError(f"{where}: missing {missing}")


@dataclass(frozen=True)
class Vocabulary:
    """Driver-side rows; ``frames`` gives them as DataFrames."""

    version: str
    convention: dict
    concepts: list[dict]
    scopes: list[dict]
    bindings: list[dict]

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        text = lambda x: None if x is None else str(x)
        make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
        key = [(b["concept_id"], *[b["context"].get(c) for c in CONTEXT]) for b in self.bindings]
        ctx = "concept_id string, scope string, phase string, role string, phase_system string"
        return {
            "concepts": make([tuple(text(c.get(k)) for k in ("concept_id", "name", "parent", "description", "value_type", "dimension", "canonical_unit", "status", "replaced_by", "source_file")) for c in self.concepts], "concept_id string, name string, parent string, description string, value_type string, dimension string, canonical_unit string, status string, replaced_by string, source_file string"),
            "aliases": make([(c["concept_id"], n, a) for c in self.concepts for n, a in enumerate(c["aliases"])], "concept_id string, seq int, alias string"),
            "edges": make([(c["concept_id"], r, t, n) for c in self.concepts for r, ts in c["relationships"].items() for n, t in enumerate(ts)], "src string, relation string, dst string, seq int"),
            "constraints": make([(c["concept_id"], k, float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None, text(v)) for c in self.concepts for k, v in c["constraints"].items()], "concept_id string, rule string, bound double, raw string"),
            "scopes": make([(s["scope_id"], s.get("name"), s.get("phases") or []) for s in self.scopes], "scope string, name string, phases array<string>"),
            "scope_aliases": make([(s["scope_id"], a) for s in self.scopes for a in s.get("aliases") or []] + [(b["context"]["scope"], a) for b in self.bindings for a in b.get("aliases") or []], "scope string, alias string"),
            "bindings": make(key, ctx),
            "binding_aliases": make([(*k, a) for k, b in zip(key, self.bindings, strict=True) for a in b.get("aliases") or []], f"{ctx}, alias string"),
            "binding_edges": make([(*k, r, t) for k, b in zip(key, self.bindings, strict=True) for r, ts in (b.get("relationships") or {}).items() for t in ts], f"{ctx}, relation string, dst string"),
        }


def load(root: str | Path, manifest: str | None = None) -> Vocabulary:
    """The vocabulary whose manifest lies in root (the one file with an ``ontology`` entry, unless named)."""
    root = Path(root)
    names = [manifest] if manifest else sorted(p.name for p in root.glob("*.yaml"))
    head = next((h for n in names if (h := _yaml(_inside(root, n)).get("ontology"))), None)
    if head is None:
        raise VocabularyError("no manifest")
    _need(head, {"version", "convention_file", "concept_files", "scope_file"}, "manifest")
    convention = _yaml(_inside(root, head["convention_file"])).get("convention") or {}
    _need(convention, {"version", "value_types", "dimensions", "relationships", "constraint_keys"}, "convention")
    for name, rule in convention["relationships"].items():
        back = (rule or {}).get("inverse")
        if back and (convention["relationships"].get(back) or {}).get("inverse") != name:
            raise VocabularyError(f"convention: {name} and {back} are not each other's inverse")
    concepts = []
    for file in head["concept_files"]:
        for n, entry in enumerate(_yaml(_inside(root, file)).get("concepts") or []):
            _need(entry, REQUIRED, f"{file}[{n}]")
            concepts.append(entry | {"description": entry["description"].strip(), "aliases": entry.get("aliases") or [], "constraints": entry.get("constraints") or {}, "relationships": entry.get("relationships") or {}, "status": entry.get("status") or "active", "source_file": file})
    scopes = _yaml(_inside(root, head["scope_file"])).get("scopes") or []
    known, bindings, seen = {c["concept_id"] for c in concepts}, [], set()
    for s in scopes:
        for b in s.get("bindings") or []:
            key = (b["concept_id"], *[b["context"].get(c) for c in CONTEXT])
            if b["concept_id"] not in known:
                raise VocabularyError(f"scope {s['scope_id']}: unknown concept {b['concept_id']}")
            if key in seen:
                raise VocabularyError(f"scope {s['scope_id']}: {key} is bound twice")
            if b["context"].get("scope") != s["scope_id"] or (p := b["context"].get("phase")) and p not in (s.get("phases") or []):
                raise VocabularyError(f"scope {s['scope_id']}: context of {b['concept_id']} does not fit")
            seen.add(key)
            bindings.append(b)
    return Vocabulary(str(head["version"]), convention, concepts, scopes, bindings)


def load_profiles(root: str | Path, pattern: str = "*.yaml") -> list[dict]:
    """Source profiles (entries) of a folder, in name order; a source term may occur once in a profile."""
    out = []
    for path in sorted(Path(root).glob(pattern)):
        p = _yaml(path)
        if "entries" not in p:
            continue
        terms = ["".join(e["source_term"].casefold().split()) for e in p["entries"]]
        if len(set(terms)) != len(terms):
            raise VocabularyError(f"{path.name}: a source term occurs twice")
        out.append({"source_system": p["source_system"], "entries": p["entries"], "activation_terms": p.get("activation_terms") or [], "requires_pressure_unit": bool(p.get("requires_pressure_unit")), "instructions": p.get("instructions")})
    return out


def select_profiles(profiles: list[dict], name: str | None = None) -> list[dict]:
    """The profiles that activate themselves, and the named one."""
    named = [p for p in profiles if p["source_system"] == name]
    if name is not None and not named:
        raise VocabularyError(f"unknown source system {name}")
    return [p for p in profiles if p["activation_terms"]] + [p for p in named if not p["activation_terms"]]


def load_platform(path: str | Path) -> dict:
    """Platform, dialect and {(concept, context or None): keyword}."""
    p, rules = _yaml(Path(path)), {}
    for name, rule in (p.get("mappings") or {}).items():
        ctx = rule.get("semantic_context")
        key = (rule.get("concept_id", name), tuple(ctx.get(c) for c in CONTEXT) if ctx else None)
        if key in rules:
            raise VocabularyError(f"{p.get('platform')}: {key} has two rules")
        rules[key] = rule["target_type"]
    return {"platform": p["platform"], "dialect": p.get("dialect"), "rules": rules}


def output_rules(platform: dict, bindings: list[dict]) -> dict:
    """{(concept, context): keyword} of a platform (load_platform), with the context of rules that name none.

    A concept bound once has that context; one bound several times, or never, needs a context of its rule; a context that is
    not bound, and two rules for one meaning, are errors.
    """
    bound: dict[str, set[tuple]] = {}
    for b in bindings:
        bound.setdefault(b["concept_id"], set()).add(tuple(b["context"].get(c) for c in CONTEXT))
    out: dict[tuple, str] = {}
    for (concept, context), keyword in platform["rules"].items():
        known = bound.get(concept, set())
        if context is None and len(known) != 1:
            raise VocabularyError(f"{platform['platform']}: the rule of {concept} needs a context: it is bound {len(known)} times")
        context = next(iter(known)) if context is None else context
        if context not in known:
            raise VocabularyError(f"{platform['platform']}: {concept} is not bound in {context}")
        if (concept, context) in out:
            raise VocabularyError(f"{platform['platform']}: two rules for {concept} in {context}")
        out[concept, context] = keyword
    return out
