"""Row files as they were at a revision of the repository that holds them."""

from __future__ import annotations

import os
import subprocess


class HistoryError(ValueError):
    """A revision or file that the repository does not have."""


def at(revision: str, path: str) -> str:
    """The text of a file at a revision, read by plain git on the driver. A file that was not there yet is empty."""
    if revision.startswith("-"):
        raise HistoryError(f"{revision} is no revision")
    folder, name = os.path.split(os.path.abspath(path))
    git = ["git", "-C", folder]
    known = subprocess.run([*git, "rev-parse", "--verify", "--quiet", f"{revision}^{{commit}}"], capture_output=True, text=True, check=False)
    if known.returncode:
        raise HistoryError(f"{folder} has no revision {revision}")
    sha = known.stdout.strip()
    there = subprocess.run([*git, "ls-tree", "--name-only", sha, "--", name], capture_output=True, text=True, check=True)
    if not there.stdout.strip():
        return ""
    return subprocess.run([*git, "show", f"{sha}:./{name}"], capture_output=True, text=True, check=True).stdout
