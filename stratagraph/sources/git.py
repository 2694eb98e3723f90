"""Git repositories as folders (S3): a shallow clone on the driver, without prompts."""

from __future__ import annotations

import os
import shutil
import subprocess

TIMEOUT_S = 600


class CloneFailed(RuntimeError):
    """git did not end well; the message is its last line."""


def clone(url: str, workspace: str, name: str, timeout: int = TIMEOUT_S) -> str:
    """The folder of a fresh clone of depth 1 under workspace; one that is there already is replaced."""
    target = os.path.join(workspace, name)
    if os.path.dirname(os.path.abspath(target)) != os.path.abspath(workspace) or url.startswith("-"):
        raise ValueError(f"no name of a folder: {name!r}, or no URL: {url!r}")
    shutil.rmtree(target, ignore_errors=True)
    os.makedirs(workspace, exist_ok=True)
    env = os.environ | {"GIT_TERMINAL_PROMPT": "0", "GIT_ASKPASS": "true", "GCM_INTERACTIVE": "never"}
    try:
        run = subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--", url, target], env=env, stdin=subprocess.DEVNULL, capture_output=True, text=True, timeout=timeout)
    except subprocess.TimeoutExpired:
        shutil.rmtree(target, ignore_errors=True)
        raise CloneFailed(f"no end after {timeout} seconds") from None
    if run.returncode:
        shutil.rmtree(target, ignore_errors=True)
        raise CloneFailed((run.stderr.strip().splitlines() or ["git failed"])[-1])
    return target
