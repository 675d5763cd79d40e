"""Where states come from and go to: tables, declarative row files, exports."""
