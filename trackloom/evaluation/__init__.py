"""Detections against annotations: matching, error measures and scores, by file (track_id) and pooled."""
