"""Writes survive failed task attempts: a session with task retries and an
injected failure still produces whole, duplicate-free outputs."""

import subprocess
import sys
from pathlib import Path


def test_writes_survive_task_failures():
    script = Path(__file__).with_name("fault_script.py")
    out = subprocess.run(
        [sys.executable, str(script)], capture_output=True, text=True, timeout=600
    )
    assert "FAULTS-OK" in out.stdout, out.stdout[-2000:] + out.stderr[-4000:]
    assert "injected task failure" in out.stderr  # the failure really happened
