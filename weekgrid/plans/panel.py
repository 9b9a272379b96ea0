"""The panel build as one plan, and its gate, report and manifest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import audits, cleaning, features, grid, labels
from ..operators.features import KEY, WEEK
from ..sources.sinks import StageStore, write_manifest, write_panel, write_tables


@dataclass
class PanelInputs:
    appearances: DataFrame
    games: DataFrame
    competitions: DataFrame
    injuries: DataFrame  # cleaned
    profiles: DataFrame | None = None
    transfers: DataFrame | None = None
    market_values: DataFrame | None = None
    value_tiebreak: str | None = None


def build_panel(
    inputs: PanelInputs, warmup: str = "documented", stages: StageStore | None = None, columns: Sequence[str] | None = None,
    ranged: bool = False, facts: DataFrame | None = None,
) -> DataFrame:
    """All panel columns, or only ``columns``, with the same rows and values: features, facts and joins that none of these needs are left out.

    What holds for a player or a season (profile, label universe, activity dates) is attached to (player, season) rows; all windowed features share
    one shuffle of these rows and of daily facts by player, and the weeks are expanded behind the windows. ``ranged``: partitions
    are ranges of players. ``stages`` keeps the joined appearances where they are read more than once;
    ``facts``: who has them already.
    """
    narrow = columns is not None and warmup == "documented"
    given = facts is not None
    facts = facts if given else grid.appearance_facts(inputs.appearances, inputs.games)
    if stages and not given and (not narrow or features.appearance_load(facts).only(columns).features):
        facts = stages.get("appearance_facts", lambda joined=facts: joined)
    target_games, _ = cleaning.filter_target_leagues(inputs.games, inputs.appearances, inputs.competitions)
    seasons = grid.cohort_seasons(target_games, facts)

    families = [
        features.appearance_load(facts),
        features.transfer_context(inputs.transfers),
        features.value_context(inputs.market_values, inputs.value_tiebreak),
        features.injury_family(inputs.injuries),
    ]
    if narrow:
        families = [family.only(columns) for family in families]

    def wanted(*names: str) -> bool:
        return columns is None or any(n in columns for n in names)

    # Columns that hold for all weeks of a player join before the weeks are there.
    labelled, enriched = wanted("label_known"), inputs.profiles is not None and wanted(*cleaning.PROFILE_COLUMNS, "age")
    own: list[str] = []
    for joins, add in ((labelled, lambda df: labels.add_label_known(df, inputs.injuries, inputs.profiles)), (enriched, lambda df: cleaning.with_profiles(df, inputs.profiles))):
        if joins:
            before = seasons.columns
            seasons = add(seasons)
            own += [c for c in seasons.columns if c not in before]
    weekly = features.weekly_features(seasons, families, ranged)
    active = F.col(WEEK).between(
        F.date_sub("first_app", S.ACTIVITY_BUFFER_DAYS), F.date_add("last_app", S.ACTIVITY_BUFFER_DAYS)
    )
    first = [KEY, WEEK, "competition_id", "season"]
    read = [c for c in weekly.columns if c not in {*first, *own, "first_app", "last_app"}]
    panel = weekly.select(*first, F.when(active, 1).otherwise(0).alias("active_player"), *read, *own)
    if warmup == "reference":
        panel = features.with_matrix_warmup(panel, facts)
    if enriched:
        panel = cleaning.with_age(panel)
    if wanted("not_censored"):
        panel = labels.add_not_censored(panel, inputs.injuries)
    return panel if columns is None else panel.select(*columns)


def run_panel_job(inputs: PanelInputs, out: str, stages: StageStore | None = None, warmup: str = "documented") -> DataFrame:
    """Gate, build, write, then report from the written table. Returns the manifest rows."""
    target_games, target_apps = cleaning.filter_target_leagues(inputs.games, inputs.appearances, inputs.competitions)
    facts = grid.appearance_facts(inputs.appearances, inputs.games)
    if stages:  # the panel is built from the same
        facts = stages.get("appearance_facts", lambda joined=facts: joined)
    cohort = grid.cohort_seasons(target_games, facts).select(KEY)
    gate = audits.overlap_gate(cohort, inputs.injuries)
    status = gate.filter(F.col("metric") == "overlap_pct").first()["status"]
    if status != "PASS":
        write_manifest(gate, f"{out}/manifest")
        raise ValueError("id overlap is below the gate; see the manifest")
    if stages:
        # From here on the written tables are read, so that the joins and aggregates they come from run once.
        interim = {name: getattr(inputs, name) for name in ("appearances", "games", "injuries")}
        write_tables(interim, stages.path("interim"))
        read = inputs.games.sparkSession.read
        inputs = replace(inputs, **{name: read.schema(df.schema).parquet(f"{stages.path('interim')}/{name}") for name, df in interim.items()})
        target_games, target_apps = cleaning.filter_target_leagues(inputs.games, inputs.appearances, inputs.competitions)
    write_panel(build_panel(inputs, warmup, stages, facts=facts if stages else None), f"{out}/panel")
    panel = inputs.games.sparkSession.read.parquet(f"{out}/panel")
    counts = audits.run_counts(panel).unionByName(
        audits.counts({
            "games": inputs.games, "appearances": inputs.appearances,
            "target_games": target_games, "target_appearances": target_apps,
        })
    )
    manifest = gate.unionByName(counts)
    write_manifest(manifest, f"{out}/manifest")
    return manifest
