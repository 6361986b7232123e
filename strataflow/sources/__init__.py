"""Result files in and out, declared schemas, fixed dimensions."""
