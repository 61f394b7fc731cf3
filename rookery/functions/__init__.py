"""Column expressions; each stays in the JVM."""

from .games import actual_score, byte_label, clock_label, display_result, eco_letter, eco_number, epoch_ms, expected_score, game_id, iso_date, residual, round_binary, shrink, speed_bucket, status
from .moves import accuracy, move_features
from .openings import family, fallback_color, last_mover, ply_count

__all__ = [
    "accuracy", "actual_score", "byte_label", "clock_label", "display_result", "eco_letter", "eco_number", "epoch_ms", "expected_score",
    "fallback_color", "family", "game_id", "iso_date", "last_mover", "move_features", "ply_count", "residual", "round_binary", "shrink", "speed_bucket", "status",
]
