"""Deterministic stand-ins for the external models, used by registered queries and tests."""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np


def hashing_embedder(texts: list[str], width: int = 64) -> list[list[float]]:
    """Word counts hashed into ``width`` places, scaled to length 1."""
    vectors = []
    for text in texts:
        vector = np.zeros(width)
        for word in re.findall(r"\w+", text.lower()):
            code = zlib.crc32(word.encode())
            vector[code % width] += 1 if code & 65536 else -1
        size = np.sqrt((vector * vector).sum())
        vectors.append((vector / size if size else vector).astype("float32").tolist())
    return vectors


def _digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def analyst(prompts: list[str]) -> list[str | None]:
    """A JSON answer per prompt; some prompts get unusable answers every time."""
    answers: list[str | None] = []
    for prompt in prompts:
        if len(prompt) % 11 == 0:
            answers.append(None)
        elif len(prompt) % 7 == 0:
            answers.append('{"summary_en": "cut off')
        elif len(prompt) % 5 == 0:
            answers.append("na na " * 12)
        else:
            answers.append(json.dumps({"summary_en": _digest(prompt)}))
    return answers


def reporter(prompts: list[str]) -> list[str | None]:
    """A whole analysis per prompt, with one organisation that is spelled in capitals by prompts of odd length."""
    answers: list[str | None] = []
    for prompt in prompts:
        if len(prompt) % 11 == 0:
            answers.append(None)
            continue
        code, name = _digest(prompt), _digest(f"organisation {len(prompt) % 40}")
        answers.append(json.dumps({
            "detected_language": "fr", "summary_en": code, "summary_orig": f"orig {code}", "topics": [code[:2]], "themes": ["t"],
            "keywords": [], "entities": [{"raw_name": name.upper() if len(prompt) % 2 else name, "entity_type": "ORG"}],
            "subscription_marketing": False, "publisher_metadata": {"author": "a", "publisher": None, "platform": "Web"},
        }))
    return answers


class HesitantAnalyst:
    """The analyst, who has no answer the first time to usable prompts whose length three divides."""

    def __init__(self):
        self._times: dict[str, int] = {}

    def __call__(self, prompts: list[str]) -> list[str | None]:
        hesitates = {p for p in prompts if len(p) % 3 == 0 and all(len(p) % k for k in (5, 7, 11))}
        for prompt in hesitates:
            self._times[prompt] = self._times.get(prompt, 0) + 1
        return [
            None if p in hesitates and self._times[p] % 2 else answer for p, answer in zip(prompts, analyst(prompts), strict=True)
        ]


def digest_embedder(texts: list[str]) -> list[list[float]]:
    """The first eight bytes of each text's digest; refuses texts whose length divides by 13, and calls that hold one."""
    if any(len(t) % 13 == 0 for t in texts):
        raise ValueError("a text was refused")
    return [[float(b) for b in bytes.fromhex(_digest(t))[:8]] for t in texts]


def judge(prompts: list[str]) -> list[str]:
    """Scores from the first four bytes of the prompt's digest."""
    answers = []
    for prompt in prompts:
        code = _digest(prompt)
        scores = [1 + int(code[i : i + 2], 16) % 5 for i in (0, 2, 4, 6)]
        answers.append(json.dumps({
            "semantic_accuracy": scores[0], "tone_alignment": scores[1], "nuance_retention": scores[2],
            "idiomatic_mapping": scores[3], "justification": f"{len(prompt)} characters",
        }))
    return answers


def low_resource_translator(prompts: list[str]) -> list[str | None]:
    """A digest of the prompt; refuses calls that hold a prompt whose length five divides."""
    if any(len(p) % 5 == 0 for p in prompts):
        raise ValueError("a prompt was refused")
    return [f"L:{_digest(p)}" for p in prompts]


def primary_translator(prompts: list[str]) -> list[str | None]:
    """A digest of the prompt; blank answers to prompts of odd length."""
    return [" " if len(p) % 2 else f"T:{_digest(p)}" for p in prompts]


def first_translator(texts: list[str]) -> list[str | None]:
    """A digest; texts of odd length come back unchanged, which counts as a failure."""
    return [f"T:{_digest(t)}" if len(t) % 2 == 0 else t for t in texts]


def second_translator(texts: list[str]) -> list[str | None]:
    """Another digest; nothing for lengths divisible by three."""
    return [f"R:{_digest(t)}" if len(t) % 3 else None for t in texts]
