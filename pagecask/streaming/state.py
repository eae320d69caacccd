"""What the pipeline remembers between runs; stored in the snapshot's manifest. Unreadable state means no consent."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

CONSENT_VERSION = 1


@dataclass(frozen=True)
class ImportState:
    status: str = "idle"  # idle, running, complete
    range_start: int | None = None
    next_end: int | None = None
    started_at: int | None = None
    completed_at: int | None = None
    processed: int = 0
    skipped: int = 0
    windows: int = 0

    @property
    def progress(self) -> float:
        """Share of the time range that is imported; newest first."""
        if self.status == "complete":
            return 1.0
        if self.status != "running" or self.range_start is None or self.next_end is None or self.started_at is None:
            return 0.0
        whole = max(1, self.started_at + 1 - self.range_start)
        return min(1.0, max(0.0, (self.started_at + 1 - self.next_end) / whole))


@dataclass(frozen=True)
class Settings:
    paused: bool = False
    retention_months: int | None = 12
    cap_mb: int = 1000
    mirror_deletion: bool = True


@dataclass(frozen=True)
class PipelineState:
    consent: int | None = None
    history: ImportState = field(default_factory=ImportState)
    last_reconcile_at: int | None = None
    reconcile_due: bool = False
    last_maintenance_at: int | None = None
    last_integrity: tuple[int, bool] | None = None
    deep_enabled: bool = False
    excluded: tuple[str, ...] = ()
    settings: Settings = field(default_factory=Settings)
    reconcile_at: int | None = None  # when the daily steps and a refresh of titles are due
    maintain_at: int | None = None
    titles_at: int | None = None

    @property
    def allowed(self) -> bool:
        return self.consent == CONSENT_VERSION

    def granted(self) -> PipelineState:
        return replace(self, consent=CONSENT_VERSION)

    def revoked(self) -> PipelineState:
        """Consent and the import's checkpoint go; data stay."""
        return replace(self, consent=None, history=ImportState(), last_reconcile_at=None, reconcile_due=False)

    def excluding(self, site: str) -> PipelineState:
        """The last 500 exclusions are kept."""
        return replace(self, excluded=(*(s for s in self.excluded if s != site), site)[-500:])

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str | None) -> PipelineState:
        try:
            raw = json.loads(text or "")
            last = raw.get("last_integrity")
            return PipelineState(
                raw.get("consent"), ImportState(**raw.get("history", {})), raw.get("last_reconcile_at"), bool(raw.get("reconcile_due")), raw.get("last_maintenance_at"),
                tuple(last) if last else None, bool(raw.get("deep_enabled")), tuple(raw.get("excluded", ())), Settings(**raw.get("settings", {})),
                raw.get("reconcile_at"), raw.get("maintain_at"), raw.get("titles_at"),
            )
        except (ValueError, TypeError, AttributeError):
            return PipelineState()
