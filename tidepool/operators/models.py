"""A registry of model profiles (TOML): its rules, which folder holds a profile's files, and whether they are the registered ones.

Only local files count; nothing is fetched.
"""

from __future__ import annotations

import hashlib
import os
import re
import tomllib
from dataclasses import dataclass
from pathlib import PurePosixPath

FORMAT = 1
#: A tokenizer family's model type, and the inputs that a graph may have.
FAMILIES = {"bert-wordpiece": "bert", "xlm-roberta-sentencepiece": "xlm-roberta"}
INPUTS = ("input_ids", "attention_mask", "token_type_ids")
KINDS = ("onnx_model", "tokenizer", "tokenizer_config", "config", "special_tokens_map", "external_data")
_TEXTS = ("license", "model_type", "model_architecture", "runtime_family", "runtime_wrapper_version", "score_kind")
_COUNTS = ("max_pair_tokens", "max_query_tokens", "tokenizer_model_max_tokens", "type_vocab_size", "expected_output_count")


class RegistryError(ValueError):
    """A registry or profile breaks its rules."""


@dataclass(frozen=True)
class Artifact:
    kind: str
    path: str
    sha256: str
    size_bytes: int


@dataclass(frozen=True)
class Profile:
    id: str
    fields: dict
    artifacts: tuple[Artifact, ...]

    def artifact(self, kind: str) -> Artifact | None:
        return next((a for a in self.artifacts if a.kind == kind), None)


def safe_path(path: str) -> bool:
    """Relative, with plain parts only."""
    return bool(path) and "\\" not in path and not path.startswith("/") and all(p not in ("", ".", "..") for p in path.split("/"))


def _whole(value, least: int = 1) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least


def problems(raw: dict) -> list[str]:
    """What is wrong with a profile as read."""
    get = raw.get
    out = []

    def rule(good: bool, said: str) -> None:
        if not good:
            out.append(said)

    rule(bool(re.fullmatch(r"[a-z0-9][a-z0-9._-]*", str(get("id", "")))), "id must be lower-case letters, digits, dots and dashes")
    rule(bool(re.fullmatch(r"[\w.-]+/[\w.-]+", str(get("repository", "")), re.ASCII)), "repository must be owner/name")
    rule(bool(re.fullmatch(r"[0-9a-f]{40}", str(get("revision", "")))), "revision must be 40 lower-case hex digits")
    for name in _TEXTS:
        rule(isinstance(get(name), str) and bool(get(name).strip()), f"{name} is empty")
    for name in _COUNTS:
        rule(_whole(get(name)), f"{name} must be at least 1")
    if all(_whole(get(name)) for name in _COUNTS):
        rule(get("max_query_tokens") <= get("max_pair_tokens"), "max_query_tokens is above max_pair_tokens")
        rule(get("max_pair_tokens") <= get("tokenizer_model_max_tokens"), "max_pair_tokens is above the tokenizer's capacity")
    rule(_whole(get("tokenizer_pad_token_id"), 0), "tokenizer_pad_token_id must not be negative")
    rule(safe_path(str(get("tokenizer_file", ""))), "tokenizer_file must be a safe relative path")
    family = get("tokenizer_family")
    rule(family in FAMILIES, f"unknown tokenizer_family {family!r}")
    rule(family not in FAMILIES or FAMILIES[family] == get("model_type"), "tokenizer_family and model_type don't go together")
    required, optional = (list(get(name) or []) for name in ("required_inputs", "optional_inputs"))
    rule(bool(required) and len(set(required + optional)) == len(required + optional), "inputs must be given, and once each")
    rule(set(required + optional) <= set(INPUTS), "inputs must be " + ", ".join(INPUTS))
    rule(set(INPUTS[:2]) <= set(required), "input_ids and attention_mask must be required")
    found = get("artifact") or []
    for a in found:
        rule(a.get("kind") in KINDS, f"unknown artifact kind {a.get('kind')!r}")
        rule(safe_path(str(a.get("path", ""))), f"artifact path {a.get('path')!r} is not a safe relative path")
        rule(bool(re.fullmatch(r"[0-9a-f]{64}", str(a.get("sha256", "")))), f"artifact {a.get('path')!r} needs a lower-case SHA-256")
        rule(_whole(a.get("size_bytes")), f"artifact {a.get('path')!r} needs a size")
    paths = [str(PurePosixPath(str(a.get("path")))) for a in found]
    rule(len(set(paths)) == len(paths), "an artifact path comes up twice")
    rule(sum(a.get("kind") == "onnx_model" for a in found) == 1, "a profile needs one onnx_model")
    return out


def parse(text: str) -> dict[str, Profile]:
    """Profiles by id of a registry's text."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise RegistryError(f"the registry is not TOML: {e}") from e
    if raw.get("format_version") != FORMAT:
        raise RegistryError(f"format_version must be {FORMAT}")
    out: dict[str, Profile] = {}
    for k, profile in enumerate(raw.get("profile") or []):
        wrong = problems(profile)
        name = str(profile.get("id", k))
        if wrong:
            raise RegistryError(f"profile {name}: " + "; ".join(wrong))
        if name in out:
            raise RegistryError(f"profile {name} comes up twice")
        artifacts = tuple(Artifact(a["kind"], a["path"], a["sha256"], a["size_bytes"]) for a in profile["artifact"])
        out[name] = Profile(name, {k: v for k, v in profile.items() if k != "artifact"}, artifacts)
    if not out:
        raise RegistryError("the registry has no profile")
    return out


def load(path: str) -> dict[str, Profile]:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def cache_folder(profile: Profile, cache: str) -> str:
    """Where a profile's files lie: by id and revision."""
    return os.path.join(cache, profile.id, profile.fields["revision"])


def verify_files(folder: str, expected: dict[str, tuple[int, str]]) -> list[str]:
    """Names of a model's files whose size or SHA-256 differs, or that are missing."""
    wrong = []
    for name, (size, digest) in expected.items():
        path = os.path.join(folder, name)
        if not os.path.isfile(path) or os.path.getsize(path) != size:
            wrong.append(name)
            continue
        with open(path, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() != digest:
                wrong.append(name)
    return wrong


def verify(profile: Profile, folder: str) -> list[str]:
    """Artifacts that are missing or differ in size or SHA-256."""
    return verify_files(folder, {a.path: (a.size_bytes, a.sha256) for a in profile.artifacts})


def resolve(name: str, profiles: dict[str, Profile], cache: str) -> tuple[str, Profile | None]:
    """(folder, profile) of a model: a folder of its own, or a profile whose files in the cache are the registered ones."""
    if name in profiles:
        folder = cache_folder(profiles[name], cache)
        wrong = verify(profiles[name], folder)
        if wrong:
            raise RegistryError(f"model {name} is not complete in {folder}: " + ", ".join(wrong))
        return folder, profiles[name]
    if os.path.isdir(name):
        return name, None
    raise RegistryError(f"{name} is neither a profile ({', '.join(sorted(profiles)) or 'none'}) nor a folder")


def graph_problems(profile: Profile, inputs: list[str], outputs: list[str]) -> list[str]:
    """What a graph has or lacks against its profile: required inputs, inputs that are neither required nor optional, outputs."""
    f = profile.fields
    out = [f"input {x} is missing" for x in f["required_inputs"] if x not in inputs]
    out += [f"input {x} is unknown" for x in inputs if x not in [*f["required_inputs"], *f.get("optional_inputs", [])]]
    if len(outputs) != f["expected_output_count"]:
        out.append(f"{len(outputs)} outputs, not {f['expected_output_count']}")
    return out


def doctor(profiles: dict[str, Profile], cache: str) -> list[tuple[str, bool, str]]:
    """(check, good, detail): the runtime and each profile's files."""
    out = []
    for package in ("onnxruntime", "tokenizers", "pyspark", "pyarrow"):
        try:
            out.append((package, True, __import__(package).__version__))
        except ImportError as e:
            out.append((package, False, str(e)))
    for name, profile in sorted(profiles.items()):
        wrong = verify(profile, cache_folder(profile, cache))
        out.append((f"model {name}", not wrong, "complete" if not wrong else "missing or changed: " + ", ".join(wrong)))
    return out
