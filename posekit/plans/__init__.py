"""Jobs composed from operators, and the registered queries."""

from posekit.plans import (  # noqa: F401
    queries_aggregates,
    queries_events,
    queries_filters,
    queries_joins,
    queries_learn,
    queries_names,
    queries_pipelines,
    queries_scalars,
    queries_sources,
    queries_stats,
    queries_stim,
    queries_tracks,
    queries_windows,
)
