"""boxloom: functions."""
