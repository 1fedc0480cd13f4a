"""Part of sievewright."""
