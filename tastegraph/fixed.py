"""Word lists, names and patterns that results depend on. They are data, not tunables; ``config`` has those."""

# Articles that a catalogue moves behind a comma, or that one side drops, for matching keys.
KEY_ARTICLES = (
    "the", "a", "an", "le", "la", "les", "l'", "il", "el", "los", "las",
    "der", "die", "das", "ein", "eine", "de", "het", "en", "et", "os", "as",
)
# Articles that are turned back for display and work keys.
SHOWN_ARTICLES = (
    "the", "a", "an", "le", "la", "les", "l'", "l’", "il", "lo", "el", "los", "las",
    "der", "die", "das", "ein", "eine", "de", "het", "en", "et", "os", "as",
    "o", "un", "una", "uno", "i", "gli",
)
# Patterns (any case) of a part marker with whatever follows it, and of a short Roman numeral at the end or before a subtitle.
PART_PATTERN = r"[\s,:;-]+(?:part|pt\.?|vol\.?|volume|chapter|book|episode)\s*(?:[ivxlcdm]+|\d+|one|two|three|four|five|six|seven|eight|nine|ten)\b.*$"
ROMAN_PATTERN = r"[\s,;-]+[ivxlcdm]{1,5}\.?\s*(?:[-–—:]\s*.*)?$"
# Title types that aren't films, and the one of short films.
TELEVISION_TYPES = ("tvEpisode", "tvSeries", "tvMiniSeries", "tvSpecial", "tvShort", "tvPilot")
SHORT_TYPE = "short"
# Headers of an export (trimmed, lower case) and their columns; every other header keeps its name, and one that ends in
# " uri" is lb_uri.
HEADERS = {"date": "logged_date", "name": "title", "watched date": "watched_date"}
# Files of an export.
EXPORT_FILES = {"ratings": "ratings.csv", "diary": "diary.csv", "reviews": "reviews.csv", "watchlist": "watchlist.csv", "watched": "watched.csv", "likes": "likes/films.csv"}
