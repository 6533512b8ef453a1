"""Column names and domain rules of the event log."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EventLog:
    """Names of the log columns, plus the rules of the learning app.

    A session belongs to one entity and to one title (hence one type and one world), as the log's data
    dictionary states.
    """

    entity: str = "installation_id"
    session: str = "game_session"
    ts: str = "timestamp"
    payload: str = "event_data"
    count: str = "event_count"
    code: str = "event_code"
    elapsed: str = "game_time"
    title: str = "title"
    kind: str = "type"
    world: str = "world"

    # The log's vocabulary and its attempt rules.
    assessment: str = "Assessment"
    game: str = "Game"
    activity: str = "Activity"
    clip: str = "Clip"
    worlds: tuple[str, ...] = ("CRYSTALCAVES", "MAGMAPEAK", "TREETOPCITY")
    attempt_code: int = 4100
    special_code: int = 4110
    special_title: str = "Bird Measurer (Assessment)"
    success_token: str = "true"
    duration_field: str = "duration"
    title_strip_chars: str = " (Assessment)"
    level_word: str = "Level"

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.session]


DEFAULT_LOG = EventLog()
