"""Column lists by name, 1-based number, range or ``*``; projection, dropping and renaming."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _split(spec: str | int | list | None) -> list:
    if spec is None:
        return []
    return list(spec) if isinstance(spec, (list, tuple)) else [spec] if isinstance(spec, int) else spec.split(",")


def _position(columns: list[str], token) -> int | None:
    """An exact header wins over a number; numbers start at 1."""
    if token in columns:
        return columns.index(token)
    text = str(token).strip()
    if text in columns:
        return columns.index(text)
    if re.fullmatch(r"\d+", text):
        if not 1 <= int(text) <= len(columns):
            raise ValueError(f"column {text} is not one of {len(columns)}")
        return int(text) - 1
    return None


def _range(columns: list[str], token) -> list[int]:
    at = _position(columns, token)
    if at is not None:
        return [at]
    for m in re.finditer("-", str(token)):
        left, right = str(token)[: m.start()], str(token)[m.end() :]
        a = 0 if not left else _position(columns, left)
        b = len(columns) - 1 if not right else _position(columns, right)
        if a is not None and b is not None and (left or right):
            if a > b:
                raise ValueError(f"range {token!r} runs backwards")
            return list(range(a, b + 1))
    raise ValueError(f"unknown column {token!r}")


def resolve(columns: list[str], include=None, exclude=None) -> list[int]:
    """Positions of the columns asked for, without the excluded ones. ``*`` stands for all that are not named elsewhere."""
    out_of = {i for t in _split(exclude) for i in _range(columns, t)}
    tokens = _split(include) or ["*"]
    named = {i for t in tokens if t != "*" for i in _range(columns, t)}
    out: list[int] = []
    for t in tokens:
        out += [i for i in range(len(columns)) if i not in named] if t == "*" else _range(columns, t)
    return [i for i in out if i not in out_of]


def renames(spec: str | dict | None) -> dict[str, str]:
    """``old=new,old2=new2`` as a mapping."""
    if not spec or isinstance(spec, dict):
        return dict(spec or {})
    pairs = [p.split("=", 1) for p in spec.split(",")]
    if any(len(p) != 2 or not all(p) for p in pairs):
        raise ValueError(f"renames must be old=new, not {spec!r}")
    return dict(pairs)


def project(df: DataFrame, columns=None, drop=None, rename=None, header: list[str] | None = None) -> DataFrame:
    """Select, drop and rename in one projection, which reaches the scan."""
    if header:
        df = df.toDF(*header)
    new = renames(rename)
    at = resolve(df.columns, columns, drop)
    unknown = set(new) - set(df.columns)
    if unknown:
        raise ValueError(f"can't rename {sorted(unknown)}")
    return df.select(*[F.col(f"`{df.columns[i]}`").alias(new.get(df.columns[i], df.columns[i])) for i in at])
