"""Canonical table schemas, accepted source spellings and other fixed values.

Everything here must equal what existing data files and published panels use; it is data, not logic.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {
        "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
        "string": T.StringType(), "date": T.DateType(), "boolean": T.BooleanType(),
    }
    fields = []
    for item in spec.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, kinds[kind], True))
    return T.StructType(fields)


# Canonical inputs (fixed values).
APPEARANCES = _struct(
    "appearance_id string, game_id long, player_id long, player_club_id long, player_current_club_id long,"
    " date date, player_name string, competition_id string, yellow_cards int, red_cards int, goals int,"
    " assists int, minutes_played double"
)
GAMES = _struct(
    "game_id long, competition_id string, season int, round string, date date, home_club_id long,"
    " away_club_id long, home_club_goals int, away_club_goals int, home_club_position int,"
    " away_club_position int, home_club_manager_name string, away_club_manager_name string, stadium string,"
    " attendance long, referee string, url string, home_club_formation string, away_club_formation string,"
    " home_club_name string, away_club_name string, aggregate string, competition_type string"
)
PLAYERS = _struct(
    "player_id long, first_name string, last_name string, name string, last_season int, current_club_id long,"
    " player_code string, country_of_birth string, city_of_birth string, country_of_citizenship string,"
    " date_of_birth date, sub_position string, position string, foot string, height_in_cm double,"
    " contract_expiration_date date, agent_name string, image_url string, url string,"
    " current_club_domestic_competition_id string, current_club_name string, market_value_in_eur double,"
    " highest_market_value_in_eur double"
)
COMPETITIONS = _struct(
    "competition_id string, competition_code string, name string, sub_type string, type string,"
    " country_id long, country_name string, domestic_league_code string, confederation string, url string,"
    " is_major_national_league boolean"
)
BACKBONE = {
    "appearances": APPEARANCES,
    "games": GAMES,
    "players": PLAYERS,
    "competitions": COMPETITIONS,
}

# Columns of the label tables that operators read, with the type they are read as (fixed values).
LABEL_TYPES = {
    "injuries": {"player_id": "bigint", "injury_start": "date", "injury_end": "date", "days_out": "double"},
    "profiles": {"player_id": "bigint", "height": "double", "date_of_birth": "date"},
    "transfers": {"player_id": "bigint", "transfer_date": "date"},
    "market_values": {"player_id": "bigint", "date": "date", "value": "double"},
}

# Header signatures by which label tables are found in a folder (fixed values).
SIGNATURES = {
    "injuries": {"player_id", "from_date", "days_missed"},
    "injuries_alt": {"player_id", "injury_start", "days_missed"},
    "injuries_irrazional": {"player_id", "from", "until", "Days"},
    "profiles": {"player_id", "height", "position", "date_of_birth"},
    "profiles_alt": {"player_id", "height", "primary_position"},
    "market_value": {"player_id", "date", "market_value_in_eur"},
    "market_value_alt": {"player_id", "date_unix", "value"},
    "transfers": {"player_id", "transfer_date", "from_team_id"},
}
SKIPPED_PATH_PART = "player_latest_market_value"

# Accepted spellings of interval columns (fixed values).
INTERVAL_NAMES = {
    "from_date": "injury_start",
    "from": "injury_start",
    "start_date": "injury_start",
    "end_date": "injury_end",
    "until_date": "injury_end",
    "until": "injury_end",
    "days": "days_out",
    "Days": "days_out",
    "days_missed": "days_out",
}
LEGACY_INTERVAL_NAMES = {
    "player": "player_name",
    "name": "player_name",
    "start": "injury_start_date",
    "end": "injury_end_date",
    "date": "injury_start_date",
    "duration": "days_out",
}

# Target leagues (fixed values).
LEAGUE_CODES = ["GB1", "ES1", "L1", "IT1", "FR1"]
LEAGUE_COUNTRIES = ["england", "spain", "germany", "italy", "france"]
LEAGUE_TIER_PATTERN = "first_tier|domestic_league"
NON_LEAGUE_NAME_PATTERN = "Cup|Pokal|Quali|Youth|U19|U21"

# Sentinels and thresholds (fixed values).
NEVER = 9999
NO_TRANSFER = 3650
PLACEHOLDER_BEFORE = "1950-01-01"
MIN_DAYS_OUT = 7
HORIZON_DAYS = 30
ACTIVITY_BUFFER_DAYS = 14
OVERLAP_GATE_PCT = 70.0
MISSING_GATE_PCT = 30.0
DOMESTIC_SHARE_GATE = 0.999
VALID_FROM = "2023-06-01"
TEST_FROM = "2024-01-01"

# Model inputs (fixed values).
BASE_FEATURES = [
    "minutes_last_4w",
    "days_since_last_played",
    "injuries_last_365d",
    "days_out_last_365d",
    "days_since_last_injury_start",
    "days_since_last_injury_end",
    "last_injury_days_out",
    "age",
]

# Columns left out of the feature catalog (fixed values).
CATALOG_EXCLUDED = [
    "player_id", "game_id", "team_id", "club_id", "competition_id", "season", "week_start",
    "target", "ineligible", "label_known", "not_censored", "active_player",
]

# Name fragments that mark a column for profiling (fixed values).
DATE_KEYWORDS = ["date", "time", "from", "until", "start", "end", "birth"]
ID_KEYWORDS = ["_id", "player_id", "game_id", "club_id", "team_id", "competition_id"]
