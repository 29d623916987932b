"""Fixed values of music theory and of the decision tables."""

from __future__ import annotations

# Fixed values -------------------------------------------------------------------
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
MAJOR_BOOSTS = {0: 1.5, 4: 1.3, 7: 1.2}
MINOR_BOOSTS = {0: 1.5 * 1.1, 3: 1.3 * 1.3, 7: 1.2 * 1.2, 10: 1.2}
GAUSS_5 = [0.000264, 0.106451, 0.786571, 0.106451, 0.000264]
SPECIAL_KEYS = [("G#", "Minor"), ("D#", "Minor"), ("F#", "Minor"), ("C#", "Minor"), ("B", "Major"), ("F#", "Major")]
NUMERALS = ["I", "bII", "II", "bIII", "III", "IV", "bV", "V", "bVI", "VI", "bVII", "VII"]
CONSONANCE = [1.0, 0.3, 0.6, 0.85, 0.95, 0.9, 0.6, 1.0, 0.8, 0.85, 0.75, 0.7]
INTERVALS = [
    "unison", "minor_second", "major_second", "minor_third", "major_third", "perfect_fourth",
    "tritone", "perfect_fifth", "minor_sixth", "major_sixth", "minor_seventh", "major_seventh",
]
MAJOR_SCALE = ["I", "II", "III", "IV", "V", "VI", "VII"]
CHORD_SHAPES = [("", (0, 4, 7), "triad"), ("m", (0, 3, 7), "triad"), ("7", (0, 4, 7, 10), "tetrad"), ("sus4", (0, 5, 7), "tetrad")]
TIME_SIGNATURES = [
    ("4/4", 4, (0,)), ("3/4", 3, (0,)), ("2/4", 2, (0,)), ("6/8", 6, (0, 3)),
    ("9/8", 9, (0, 3, 6)), ("12/8", 12, (0, 3, 6, 9)), ("5/4", 5, (0,)), ("7/8", 7, (0, 3)),
]
INSTRUMENTS = [
    ("vocals", 80.0, 1100.0), ("piano", 27.5, 4186.0), ("guitar", 82.0, 1319.0), ("electric_guitar", 82.0, 2093.0), ("bass", 20.0, 250.0),
    ("synthesizer", 20.0, 8000.0), ("strings", 196.0, 2093.0), ("brass", 87.0, 1175.0), ("woodwinds", 147.0, 2093.0), ("drums", 20.0, 8000.0),
    ("kick_drum", 20.0, 100.0), ("snare_drum", 150.0, 4000.0), ("hi_hat", 5000.0, 20000.0), ("cymbals", 3000.0, 20000.0), ("organ", 16.0, 4186.0),
    ("flute", 262.0, 2093.0), ("violin", 196.0, 3136.0), ("cello", 65.0, 1047.0), ("saxophone", 138.0, 880.0),
]
VOCAL_RANGES = [("Bass", 41, 65), ("Baritone", 45, 69), ("Tenor", 48, 72), ("Alto", 53, 77), ("Mezzo-Soprano", 57, 81), ("Soprano", 60, 84)]
SECTION_LETTERS = {
    "intro": "I", "verse": "A", "pre_chorus": "R", "chorus": "B", "bridge": "C", "instrumental": "D",
    "break": "K", "interlude": "L", "solo": "S", "spoken": "P", "outro": "O",
}
WEIGHTED_RANGES = [
    ("basic", 0, 3, 0.05), ("harmonic", 3, 11, 0.25), ("rhythmic", 11, 19, 0.20), ("timbral", 19, 41, 0.20), ("structural", 41, 51, 0.15), ("melodic", 51, 65, 0.10), ("dynamic", 65, 77, 0.10),
]
HARMONIC_RATIOS = [0.5, 2 / 3, 0.75, 1.0, 4 / 3, 1.5, 2.0, 3.0, 4.0]
# --------------------------------------------------------------------------------


def profile(mode: str) -> list[float]:
    """The boosted key profile of a mode, tonic first, with sum 1."""
    base, boosts = (MAJOR_PROFILE, MAJOR_BOOSTS) if mode == "Major" else (MINOR_PROFILE, MINOR_BOOSTS)
    raised = [x * boosts.get(i, 1.0) for i, x in enumerate(base)]
    return [x / sum(raised) for x in raised]


def key_profiles() -> list[tuple[int, str, str, int, float]]:
    """(key_idx, key, mode, pc, weight): 24 rotations, major and minor in turn."""
    shapes = {m: profile(m) for m in ("Major", "Minor")}
    return [(2 * r + k, NOTES[r], mode, pc, shapes[mode][(pc - r) % 12]) for r in range(12) for k, mode in enumerate(("Major", "Minor")) for pc in range(12)]


def chord_templates() -> list[tuple[int, str, str, int]]:
    """(ord, chord, kind, pc): the pitch classes of each chord, in order of roots."""
    shapes = [(s, pcs, kind) for s, pcs, kind in CHORD_SHAPES]
    return [(4 * r + i, NOTES[r] + s, kind, (r + p) % 12) for r in range(12) for i, (s, pcs, kind) in enumerate(shapes) for p in pcs]
