"""Keeping a table's copy up to date in the background."""

from __future__ import annotations

import threading

from tributary.plans.engine import FederationEngine


class Refresher:
    """Refreshes the copy of one federated table now and every so many seconds, until it is stopped.

    A round that fails is noted in ``error`` and tried again in the next; the copy stays as it was.
    """

    def __init__(self, engine: FederationEngine, name: str, seconds: float | None = None):
        copy = engine._get(name).copy
        self.engine, self.name = engine, name
        self.seconds = seconds if seconds is not None else (copy.refresh_seconds if copy else 300.0)
        self.rounds, self.error = 0, None
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, name=f"refresh-{name}", daemon=True)

    def _run(self) -> None:
        while not self._stop.is_set():
            try:
                self.engine.refresh(self.name)
                self.error = None
            except Exception as e:
                self.error = e
            self.rounds += 1
            self._stop.wait(self.seconds)

    def start(self) -> Refresher:
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()

    def __enter__(self) -> Refresher:
        return self.start()

    def __exit__(self, *_) -> None:
        self.stop()
