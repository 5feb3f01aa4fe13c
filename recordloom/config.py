"""Settings of a run.  Every number and table that decides a result is a field here."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from recordloom import fixed_values as fv


def flat_lookup(table: dict[str, list[str]]) -> dict[str, str]:
    """{canonical: [aliases]} -> {lower-case alias: canonical}; a later entry replaces an earlier one."""
    flat: dict[str, str] = {}
    for canonical, aliases in table.items():
        flat[canonical.lower()] = canonical
        for alias in aliases:
            flat[alias.lower()] = canonical
    return flat


@dataclass(frozen=True)
class Settings:
    # The moment that counts as "now": ages, future dates and the run time all use it.
    as_of: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    region: str = "DZ"
    phone_rules: list = field(default_factory=lambda: list(fv.PHONE_RULES))
    field_aliases: dict = field(default_factory=lambda: dict(fv.FIELD_ALIASES))
    provinces: dict = field(default_factory=lambda: flat_lookup(fv.PROVINCES))
    subjects: dict = field(default_factory=lambda: flat_lookup(fv.SUBJECTS))
    mapping_threshold: float = fv.MATCH_THRESHOLD
    lookup_threshold: float = fv.MATCH_THRESHOLD
    duplicate_threshold: float = fv.MATCH_THRESHOLD
    duplicate_weights: dict = field(default_factory=lambda: dict(fv.DUPLICATE_WEIGHTS))
    default_picture: str = fv.DEFAULT_PICTURE
    default_user_type: str = fv.DEFAULT_USER_TYPE
    default_gender: str = fv.DEFAULT_GENDER
    default_school_type: str = fv.DEFAULT_SCHOOL_TYPE
    email_domain: str = fv.DEFAULT_EMAIL_DOMAIN
    placeholder_phone: str | None = None
    suffix_digits: int = 4
    forest_trees: int = 100
    forest_sample: int = 256
    seed: int = 42
    # Older behaviours, off by default; README explains each of them.
    missing_dob_matches: bool = False
    legacy_compose: bool = False
    legacy_dob_range: bool = False
    # Scale knobs: none of them changes a result.
    bucket_rows: int = 20_000
    tile_rows: int = 4_096

    @property
    def as_of_seconds(self) -> int:
        return int(self.as_of.timestamp())
