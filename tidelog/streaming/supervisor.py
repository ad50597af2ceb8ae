"""Supervision of the tenants' queries: start, stop, restart with backoff, health."""

from __future__ import annotations

import logging
import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from tidelog.functions.config import backoff_ms, worker_state

log = logging.getLogger("tidelog")

IDLE, CONNECTING, STREAMING, PAUSED, RECONNECTING, STOPPING, STOPPED, FAILED = range(8)


@dataclass
class Reconnection:
    """Attempts with growing delays; a delay comes before every attempt, the first included."""

    most: int = -1  # no limit
    base_ms: int = 500
    factor: float = 2.0
    most_ms: int = 60_000
    jitter: float = 0.25
    stable_s: float = 60.0
    failures: int = 0
    since: float | None = None
    tries: int = 0  # since the connection was last lost, or held long enough
    rng: random.Random = field(default_factory=random.Random)

    def delay_ms(self) -> int:
        return backoff_ms(self.failures, self.base_ms, self.factor, self.most_ms, self.jitter, self.rng)

    def connect(self, attempt: Callable[[], bool], stop: threading.Event, sleep: Callable[[float], object] | None = None) -> bool:
        """Try until ``attempt`` succeeds, the limit is reached or ``stop`` is set."""
        tries = 0
        wait = sleep or stop.wait
        while not stop.is_set() and (self.most < 0 or tries < self.most):
            wait(self.delay_ms() / 1000)
            if stop.is_set():
                return False
            tries += 1
            try:
                if attempt():
                    self.failures, self.since = 0, time.monotonic()
                    return True
            except Exception:
                log.exception("attempt %d failed", tries)
            self.failures += 1
        return False

    def stable(self) -> bool:
        """Whether the connection has held long enough to forget earlier failures."""
        if self.since is not None and time.monotonic() - self.since >= self.stable_s:
            self.failures = self.tries = 0
            return True
        return False

    def lost(self) -> float | None:
        """Note a failure; the time of the next attempt, or None where the limit is reached."""
        if 0 <= self.most <= self.tries:
            return None
        self.since = None
        due = time.monotonic() + self.delay_ms() / 1000
        self.failures += 1
        self.tries += 1
        return due


@dataclass
class Worker:
    """A tenant's query and its state.

    With a ``policy``, a query that fails is started again from its own
    checkpoint, after a delay that doesn't hold up other workers; without one,
    or at the policy's limit, the worker ends.
    """

    tenant: str
    settings: dict
    start: Callable[[], object]  # returns a StreamingQuery
    state: int = IDLE
    query: object | None = None
    reconnections: int = 0
    errors: int = 0
    policy: Reconnection | None = None
    due: float = 0.0

    def begin(self) -> bool:
        self.state = CONNECTING
        try:
            self.query = self.start()
        except Exception:
            log.exception("tenant %s: the query could not be started", self.tenant)
            self.errors += 1
            self.state = FAILED
            return False
        self.state = STREAMING
        if self.policy is not None:
            self.policy.since = time.monotonic()
        return True

    def refresh(self) -> int:
        """State as the query's own status gives it; an attempt to reconnect is made when it is due."""
        if self.state == STREAMING and self.query is not None and not self.query.isActive:
            failed = self.query.exception() is not None
            self.errors += failed
            self.state = STOPPED
            if failed:
                self._lost()
        elif self.state == STREAMING and self.policy is not None:
            self.policy.stable()
        elif self.state == RECONNECTING and time.monotonic() >= self.due:
            if self.begin():
                self.reconnections += 1
            else:
                self._lost()
        return self.state

    def _lost(self) -> None:
        due = None if self.policy is None else self.policy.lost()
        self.state, self.due = (FAILED, 0.0) if due is None else (RECONNECTING, due)

    def stop(self) -> None:
        try:
            if self.query is not None and self.query.isActive:
                self.query.stop()
        except Exception:  # the session may be gone already; the query's position is in its checkpoint
            log.exception("tenant %s: the query could not be stopped", self.tenant)
        self.state = STOPPED

    def snapshot(self) -> dict:
        progress = getattr(self.query, "lastProgress", None) or {}
        return {
            "tenant": self.tenant, "state": worker_state(self.refresh()), "errors": self.errors, "reconnections": self.reconnections,
            "rows": progress.get("numInputRows", 0), "batch": progress.get("batchId", -1), "last_activity": progress.get("timestamp"),
        }


class Supervisor:
    """Keeps the running workers equal to the desired tenants."""

    def __init__(self, make: Callable[[dict], Callable[[], object]], most: int = 64, policy: Callable[[], Reconnection] | None = None):
        self.make, self.most, self.policy = make, most, policy
        self.workers: dict[str, Worker] = {}
        self.stopping = threading.Event()

    def start_worker(self, tenant: str, settings: dict) -> bool:
        if tenant in self.workers:
            return False
        self.workers[tenant] = worker = Worker(tenant, settings, self.make(settings), policy=self.policy() if self.policy else None)
        return worker.begin()

    def stop_worker(self, tenant: str) -> bool:
        worker = self.workers.pop(tenant, None)
        if worker is None:
            return False
        worker.stop()
        return True

    def poll(self, desired: dict[str, dict]) -> dict[str, list[str]]:
        """One reconciliation; returns what was started, stopped and skipped. Tenants with new settings are restarted."""
        done: dict[str, list[str]] = {"start": [], "stop": [], "skip": []}
        for tenant in sorted(self.workers):
            if tenant not in desired or desired[tenant] != self.workers[tenant].settings:
                self.stop_worker(tenant)
                done["stop"].append(tenant)
        for tenant in sorted(desired):
            if tenant in self.workers:
                continue
            if len(self.workers) >= self.most:
                log.warning("tenant %s skipped: %d workers run already", tenant, self.most)
                done["skip"].append(tenant)
                continue
            self.start_worker(tenant, desired[tenant])
            done["start"].append(tenant)
        return done

    def reap(self) -> list[str]:
        """Remove workers that have ended; the next poll starts them again."""
        ended = [t for t, w in self.workers.items() if w.refresh() in (STOPPED, FAILED)]
        for tenant in ended:
            del self.workers[tenant]
        return ended

    def health(self) -> list[dict]:
        return [w.snapshot() for w in self.workers.values()]

    def run(self, desired: Callable[[], dict[str, dict]], tick_s: float = 0.5, poll_s: float = 30.0, health_s: float = 10.0, report: Callable[[list[dict]], object] | None = None) -> None:
        """The loop: reap at each tick, poll and report at their intervals, until ``shutdown``.

        Where the tenants' list can't be read the workers go on as they are and
        it is read again after a growing delay. ``report`` gets the workers'
        snapshots at each health check and before they are stopped.
        """
        next_poll = next_health = 0.0
        admin = self.policy() if self.policy else Reconnection()
        admin.most = -1
        while not self.stopping.is_set():
            now = time.monotonic()
            self.reap()
            if now >= next_poll:
                try:
                    wanted = desired()
                except Exception:
                    log.exception("the tenants' list can't be read")
                    next_poll = admin.lost() or now + poll_s
                else:
                    admin.failures = 0
                    self.poll(wanted)
                    next_poll = now + poll_s
            if now >= next_health:
                self._report(report)
                next_health = now + health_s
            self.stopping.wait(tick_s)
        self._report(report)
        self.close()

    def _report(self, report: Callable[[list[dict]], object] | None) -> None:
        try:
            snapshots = self.health()
            for snapshot in snapshots:
                log.info("worker %s", snapshot)
            if report is not None:
                report(snapshots)
        except Exception:  # a report that is missed is made up for by the next
            log.exception("the report failed")

    def shutdown(self) -> None:
        self.stopping.set()

    def close(self) -> dict:
        """Stop all workers; the summary is taken before they go, positions are kept by their queries."""
        try:
            summary = {"workers": len(self.workers), "health": self.health()}
        except Exception:
            log.exception("no last look at the workers")
            summary = {"workers": len(self.workers), "health": []}
        for tenant in list(self.workers):
            self.stop_worker(tenant)
        log.info("stopped %d workers", summary["workers"])
        return summary
