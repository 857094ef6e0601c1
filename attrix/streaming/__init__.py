from attrix.streaming.scoring import score_frame, start_scoring

__all__ = ["score_frame", "start_scoring"]
