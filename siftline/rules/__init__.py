"""Rule packs as data."""
