"""Repositories on the driver: local folders, clones, commits, index names."""

from __future__ import annotations

import os
import re
import subprocess


def _git(*args: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", *args], capture_output=True, text=True)


def load_repository(repo: str, destination_root: str) -> str:
    """A local folder for a path or an address; a clone that is there already is brought up to date."""
    if os.path.exists(repo):
        return os.path.realpath(repo)
    target = os.path.join(destination_root, index_name(repo))
    os.makedirs(destination_root, exist_ok=True)
    done = _git("-C", target, "pull", "--ff-only") if os.path.isdir(os.path.join(target, ".git")) else _git("clone", repo, target)
    if done.returncode:
        raise RuntimeError(f"git failed for {repo}: {done.stderr.strip()}")
    return os.path.realpath(target)


def current_commit(path: str) -> str | None:
    try:
        done = _git("-C", path, "rev-parse", "HEAD")
    except OSError:
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def index_name(repo: str) -> str:
    """Last part of a path or address, without .git, in lower case with dashes."""
    base = repo.rstrip("/").rsplit("/", 1)[-1].rsplit(":", 1)[-1]
    if not os.path.exists(repo) or base.endswith(".git"):
        base = base.removesuffix(".git")
    return re.sub(r"[^A-Za-z0-9]+", "-", base).strip("-").lower() or "repository"
