"""References to stored datasets: ``label:group:path``."""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_uppercase


@dataclass(frozen=True)
class DatasetRef:
    """A dataset path with an optional label and an optional group in it."""

    path: str
    group: str = ""
    label: str = ""

    @classmethod
    def parse(cls, text: str, group: str = "") -> DatasetRef:
        """``path``, ``group:path`` or ``label:group:path``; the group must not contradict ``group``."""
        parts = [p.strip() for p in text.split(":")]
        if len(parts) > 3:
            raise ValueError(f"cannot read dataset reference {text}")
        path, named, label = parts[-1], parts[-2] if len(parts) > 1 else "", parts[0] if len(parts) == 3 else ""
        if named.lower() in ("default", "auto"):
            named = ""
        if group.lower() in ("default", "auto"):
            group = ""
        if named and group and named.strip("/") != group.strip("/"):
            raise ValueError(f"group {group} contradicts {text}")
        return cls(path, named or group, label)

    @classmethod
    def parse_all(cls, texts: list[str], prefix: str = "") -> list[DatasetRef]:
        """Several references; those without label get A, B, C, ... (after ``prefix``)."""
        if len(texts) > len(ascii_uppercase):
            raise ValueError("at most 26 datasets can be combined")
        refs = [cls.parse(t) for t in texts]
        return [r if r.label else cls(r.path, r.group, prefix + letter) for r, letter in zip(refs, ascii_uppercase)]

    @classmethod
    def parse_feature(cls, text: str, assembly: str = "") -> DatasetRef:
        """The strict three-part form of feature inputs; the file name must contain the assembly."""
        if text.count(":") != 2:
            raise ValueError(f"expected label:group:path, got {text}")
        ref = cls.parse(text)
        if assembly and assembly not in ref.path.rstrip("/").rsplit("/", 1)[-1]:
            raise ValueError(f"assembly {assembly} is not part of the file name in {text}")
        return cls(ref.path, ref.group, ref.label.strip("_"))
