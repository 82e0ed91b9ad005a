"""Feature names, weights and scoring options (PF2, PF3, UD4)."""

from __future__ import annotations

from dataclasses import dataclass, field

# The song features in order, and the names they may be called by.
FEATURES = ("bpm", "danceability", "valence", "energy", "acousticness", "instrumentalness", "liveness", "speechiness")
FEATURE_NAMES = {
    "tempo": "bpm", "bpm": "bpm", "dance": "danceability", "danceability": "danceability", "valence": "valence", "mood": "valence", "happiness": "valence",
    "energy": "energy", "acoustic": "acousticness", "acousticness": "acousticness", "instrumental": "instrumentalness", "instrumentalness": "instrumentalness",
    "live": "liveness", "liveness": "liveness", "speech": "speechiness", "speechiness": "speechiness",
}
# Headers of song tables and the columns they become.
HEADERS = {
    "title": "title", "track": "title", "name": "title", "artist(s)": "artist", "artist": "artist", "artists": "artist", "release": "release", "released_year": "release",
    "num_of_streams": "streams", "streams": "streams", "bpm": "bpm", "tempo": "bpm", "key": "key", "mode": "mode",
} | {h: f for f in FEATURES[1:] for h in (f, f"{f}_%")}
# Weights of the acoustic and of the vibe ranking; others weigh 1.
ACOUSTIC_WEIGHTS = {"tempo": 1.5, "rms_energy": 1.5}
VIBE_WEIGHTS = {"low_end_ratio": 3.0, "crest": 2.5, "dynamic_range": 2.5, "rms_std": 2.0, "band_sub": 2.5, "band_bass": 2.0, "tempo": 1.5, "onset_rate": 1.5, "brightness": 1.5}


def feature(name: str) -> str:
    """PF2: the column a name stands for."""
    found = FEATURE_NAMES.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown feature {name!r}; known: {', '.join(FEATURES)}")
    return found


def weights(said: list[str] | str) -> dict[str, float]:
    """PF3: NAME=VALUE items, or one text of them with commas between."""
    items = said.split(",") if isinstance(said, str) else said
    out = {}
    for item in filter(None, (x.strip() for x in items)):
        name, eq, value = item.partition("=")
        if not eq:
            raise ValueError(f"{item!r} is not NAME=VALUE")
        out[feature(name)] = float(value)
    return out


@dataclass(frozen=True)
class Scoring:
    """PF2, UD4: which features count, how much, and how distances become scores."""

    features: tuple[str, ...] = FEATURES
    weights: dict[str, float] = field(default_factory=dict)
    metric: str = "euclidean"

    def __post_init__(self) -> None:
        wrong = [f for f in self.features if f not in FEATURES]
        problems = [
            f"unknown features: {', '.join(wrong)}" if wrong else "", "" if self.features else "no features",
            "" if self.metric in ("euclidean", "cosine") else f"unknown metric {self.metric!r}",
            *(f"negative weight of {k}" for k, w in self.weights.items() if w < 0),
        ]
        if any(problems):
            raise ValueError("; ".join(filter(None, problems)))

    def vector(self) -> list[float]:
        return [float(self.weights.get(f, 1.0)) for f in self.features]
