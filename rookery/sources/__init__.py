"""Where games and openings come from."""

from .download import download
from .feed import FeedReader, collected, diverse_players, flatten_feed, read_feed, read_leaderboard, user_games
from .openings import openings_dim
from .pgn import games_of, parsed, read_records, reject_counts, transcode

__all__ = [
    "FeedReader", "collected", "diverse_players", "download", "flatten_feed", "games_of", "openings_dim", "parsed",
    "read_feed", "read_leaderboard", "read_records", "reject_counts", "transcode", "user_games",
]
