"""The same conversions over a folder that files arrive in."""
