"""Operators for building training corpora; nothing else in posekit imports this."""
