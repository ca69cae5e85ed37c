"""Evidence-consistency analytics as plain DataFrame -> DataFrame functions."""
