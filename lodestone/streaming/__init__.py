"""The dialect has no streaming statements; nothing is here."""
