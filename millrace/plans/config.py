"""Configurations of variants: a family's settings and the variants that they hold for."""

from __future__ import annotations

import json

FAMILIES = {"wordpiece": "bert", "bpe": "bpe", "unigram": "unigram"}


def _value(text: str):
    text = text.split(" #", 1)[0].strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1]:
        return text[1:-1]
    return {"true": True, "false": False, "null": None, "": None}.get(text, int(text) if text.lstrip("-").isdigit() else text)


def parse(text: str) -> dict:
    """Settings of one level, and lists of settings below them: as much of the notation as these files use."""
    out, items = {}, None
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        indented = raw[:1] in " \t"
        if line.startswith("- "):
            if items is None:
                raise ValueError(f"line {number}: an item of no list")
            items.append({})
            line, indented = line[2:], True
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"line {number}: no setting")
        if indented:
            if not items:
                raise ValueError(f"line {number}: a setting of no item")
            items[-1][key.strip()] = _value(value)
        else:
            out[key.strip()] = _value(value)
            items = None
            if out[key.strip()] is None:
                items = out[key.strip()] = []
    return out


def variants(text: str, only: str | None = None) -> list[dict]:
    """Each variant with the family's settings, unless it has its own; or the one named. None of that name is an error."""
    read = json.loads(text) if text.lstrip().startswith("{") else parse(text)
    found = [{**{k: v for k, v in read.items() if k != "variants"}, **v} for v in read.get("variants") or []]
    if only is not None:
        found = [v for v in found if v.get("name") == only]
        if not found:
            raise ValueError(f"no variant named {only!r}")
    for v in found:
        if v.get("model_type") not in FAMILIES:
            raise ValueError(f"unknown model type {v.get('model_type')!r}")
    return found
