"""Part of sievewright; see README.md."""
