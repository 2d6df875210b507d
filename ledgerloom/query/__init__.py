"""The front door: filtered pages of tables, profiles, and questions in plain English."""
