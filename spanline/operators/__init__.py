"""Table operators over turns, segments, trials, reviews and cues."""
