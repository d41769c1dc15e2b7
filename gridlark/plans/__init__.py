"""Rules as data, keyed by profile, and the plans composed from them."""
