"""Who may index: a lease file beside the tables, renewed by its owner."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from pathlib import Path

STALE_S, HEARTBEAT_S, POLL_S, MAX_ERRORS = 60, 30, 15, 10


def may_own(lease: dict | None, pid: int, instance: str, now: float, alive: Callable[[int], bool]) -> bool:
    """No owner, a dead one, a heartbeat of STALE_S or older, or our own process id used again."""
    if lease is None or not alive(lease["pid"]):
        return True
    return int(now - lease["heartbeat"]) >= STALE_S or (lease["pid"] == pid and lease["instance"] != instance)


def process_alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


class Lease:
    """A driver's claim on a folder that drivers share. The file is replaced whole, so readers see one lease or none."""

    def __init__(self, folder: str, pid: int | None = None, clock: Callable[[], float] = time.time, alive: Callable[[int], bool] = process_alive):
        self.path, self.pid, self.instance = Path(folder) / "lease.json", pid or os.getpid(), uuid.uuid4().hex
        self.clock, self.alive = clock, alive

    def read(self) -> dict | None:
        try:
            return json.loads(self.path.read_text())
        except (OSError, ValueError):
            return None

    def _write(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        new = self.path.with_suffix(f".{self.instance}")
        new.write_text(json.dumps({"pid": self.pid, "instance": self.instance, "heartbeat": self.clock()}))
        os.replace(new, self.path)

    def acquire(self) -> str:
        """``owner`` or ``reader``."""
        lease = self.read()
        if lease and lease["instance"] == self.instance or may_own(lease, self.pid, self.instance, self.clock(), self.alive):
            self._write()
            return "owner"
        return "reader"

    def heartbeat(self) -> bool:
        """Renews an own lease; False if another took it."""
        lease = self.read()
        if not lease or lease["instance"] != self.instance:
            return False
        self._write()
        return True

    def release(self) -> None:
        lease = self.read()
        if lease and lease["instance"] == self.instance:
            self.path.unlink(missing_ok=True)
