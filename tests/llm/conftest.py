import sys

import pytest


@pytest.fixture(autouse=True)
def own_peak(request, monkeypatch, tmp_path):
    """A program started by exec counts the peak memory of the process it was started from as its own; one started by a shell does not."""
    if request.node.path.name == "test_long_texts.py":
        shell = tmp_path / "python"
        shell.write_text(f'#!/bin/sh\n"{sys.executable}" "$@"\nexit $?\n')
        shell.chmod(0o755)
        monkeypatch.setattr(sys, "executable", str(shell))
