"""Schemas of the catalogue's tables, and the engine's constants."""


def _s(**fields: str) -> str:
    """A schema as DDL, which needs no session to be stated."""
    return ", ".join(f"{k} {v}" for k, v in fields.items())


ARTISTS = _s(id="bigint", name="string", meta_json="string", legacy_json="string", similar_fetched_at="timestamp")
ALBUMS = _s(id="string", artist_id="bigint", title="string", release_date="string", label="string", genre="string", image="string", meta_json="string", legacy_json="string")
TRACKS = _s(id="bigint", album_id="string", artist_id="bigint", title="string", duration="bigint", isrc="string", meta_json="string", legacy_json="string", seed_distance="bigint")
DESCRIPTORS = "struct<bpm:double,key:string,scale:string,key_strength:double,loudness:double,dynamics:double>"
FEATURES = _s(track_id="bigint", extractor_version="string", descriptors_json="string", clap="array<float>", analysed_at="timestamp")
FRONTIER = _s(kind="string", ref_id="string", priority="bigint", state="string")
LAYOUT = _s(track_id="bigint", x="double", y="double")
FAILURES = _s(track_id="bigint", stage="string", reason="string", failed_at="timestamp")
BLOCKED = _s(artist_id="bigint", name="string", reason="string", blocked_at="timestamp")
LYRICS = _s(track_id="bigint", status="string", language="string", confidence="double", reliable="boolean", checked_at="timestamp")
MIX = _s(track_id="bigint", version="string", entry_json="string", analysed_at="timestamp", drops="boolean")
MIX_QUEUE = _s(track_id="bigint", priority="bigint", reason="string", queued_at="timestamp", seq="bigint")
LISTENS = _s(id="string", user_id="bigint", device_id="string", track_id="bigint", started_at="bigint", listened_seconds="double", track_seconds="double", ended="string")
REFS = _s(kind="string", id="string", provider="string", ref="string", isrc="string", match_key="string", seconds="double")
TRACK_MERGES = _s(from_id="bigint", into_id="bigint", similarity="double", merged_at="timestamp")
SPACE = _s(track_id="bigint", row_no="bigint", raw="array<float>")

# The blocks of the space in order, with their default weights.
BLOCK_WEIGHTS = {
    "tempo": 1.0,
    "key": 0.4,
    "dynamics": 0.8,
    "timbre": 0.6,
    "mood": 1.2,
    "style": 1.5,
    "era": 0.3,
    "semantic": 2.0,
    "language": 0.6,
}
BPM_LOW, BPM_HIGH = 70.0, 140.0
STYLE_COMPONENTS, SEMANTIC_COMPONENTS = 20, 40
LANGUAGE_LEAST, LANGUAGE_MOST = 20, 24
COOLDOWN = 3
WAYPOINTS, CORRIDOR, CORRIDOR_WIDER = 17, 384, 768
GRAPH_K, SAME_ARTIST = 16, 0.05
ORDER_MOST, ORDER_PASSES, ORDER_EPSILON = 1024, 32, 1e-6
DRIFT_ANCHORS, GENERATE_MOST, DESCRIBE_WORDS, SEARCH_LIMIT = 5, 500, 12, 720
SAME, SAME_OTHER_ISRC, LENGTH_SLACK = 0.995, 0.999, 2
UMAP_K, MIN_DIST, SPREAD, NEGATIVES, SEED = 15, 0.1, 1.0, 5, 42
FINISH_SLACK, FINISH_SHARE, CLOCK_SLACK, PLAYED_MOST = 15.0, 0.1, 2.0, 240.0
RECHECK_DAYS = 90
PHRASES_MOST = 65_535
