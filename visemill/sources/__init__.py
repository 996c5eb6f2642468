"""Readers and writers of labels, manifests, features, logs and subtitles."""
