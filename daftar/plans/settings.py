"""Paths and switches of a run from environment variables, then from arguments."""

from __future__ import annotations

import os
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    input: str = ""
    corpus: str = ""
    apply: bool = False
    dry_run: bool = False
    concurrency: int = 6


def settings(env: Mapping[str, str] | None = None, argv: Sequence[str] | None = None) -> Settings:
    """INPUT_PATH, CORPUS_PATH, APPLY, DRY_RUN and CONCURRENCY; the first two arguments win over the paths."""
    env, argv = os.environ if env is None else env, sys.argv[1:] if argv is None else argv
    paths = [*argv[:2], *[""] * 2]
    return Settings(paths[0] or env.get("INPUT_PATH", ""), paths[1] or env.get("CORPUS_PATH", ""), env.get("APPLY") == "1", env.get("DRY_RUN") == "1", int(env.get("CONCURRENCY") or Settings.concurrency))
